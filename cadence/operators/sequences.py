"""Play sequences: F11, J9, W5, W6, W15, R5, R6 and the default sequence model for R4.

Per-session order is needed here. Where a step would otherwise sort a whole session in one
task (a hot session may hold a third of all plays), it is written as a bucketed range join or
a window-group-limit, so the work per task stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.means import vector_means
from cadence.operators.numbering import changes, numbered
from cadence.session import materialise

MAX_SEQ_LEN = 15  # fixed value of the reference's sequence model
SUB_SESSION_SONGS = 10  # fixed value of the reference's player
SEQUENCE_CHUNK = 1000  # plays of one array
BUCKET_CONTEXTS = 100  # a bucket of plays is this many times as long as a sample's context
BLOCK_PLAYS = 100_000  # plays of a block, on average: no more vectors are held at once


def known_plays(plays: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plays whose song is in the catalog (unknown ids skipped), with the embedding."""
    emb = catalog.select("video_id", V.as_double_array("embedding").alias("embedding"))
    return plays.join(emb, "video_id")


def last_n(plays: DataFrame, n: int = MAX_SEQ_LEN) -> DataFrame:
    """Last ``n`` plays per session (planned as a window-group-limit: each partition keeps at
    most n rows per session before the shuffle, so a hot session costs n rows per task)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("play_order"))
    return plays.withColumn("_from_end", F.row_number().over(w)).where(F.col("_from_end") <= n)


def recent_mean_model(plays: DataFrame, catalog: DataFrame, session_state: DataFrame,
                      n: int = MAX_SEQ_LEN) -> DataFrame:
    """Default sequence model for R4: the predicted next-song vector of an active session is
    the mean embedding of its last ``n`` known plays. Any model producing
    (session_id, vector) can replace it (see ``gru_forward`` for a supplied GRU)."""
    active = session_state.where(F.col("gru_active")).select("session_id")
    known = plays.join(active, "session_id", "left_semi").join(catalog.select("video_id"), "video_id")
    recent = last_n(known.select("session_id", "play_order", "video_id"), n)
    return vector_means(recent, ["session_id"], catalog, joined=True).select("session_id", "vector")


def play_sequences(plays: DataFrame, min_len: int = 2, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Ordered sequence per session, sessions with at least ``min_len`` plays, in chunks of bounded
    length: (session_id, chunk, sequence array<struct<play_order, video_id, liked_flag>>). ``plays``
    carry their number in the session (``play_order`` from 1, see ``numbering``), so a session of any
    length spreads over tasks and no array holds more than ``chunk`` plays."""
    if min_len > chunk:
        raise ValueError("min_len must not be larger than a chunk")
    part = F.expr(f"(play_order - 1) div {chunk}").alias("chunk")
    return (plays.groupBy("session_id", part)
            .agg(F.sort_array(F.collect_list(F.struct("play_order", "video_id", "liked_flag"))).alias("sequence"))
            # a later chunk exists only if the first is full
            .where((F.col("chunk") > 0) | (F.size("sequence") >= min_len)))


def eligible_sequences(plays: DataFrame, min_events: int = 5) -> DataFrame:
    """drop blank ids, then keep sessions with >= min_events both before and after."""
    n0 = plays.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n0"))
    kept = plays.where(F.col("video_id").isNotNull() & (F.trim(F.col("video_id").cast("string")) != ""))
    n1 = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n1"))
    ok = n0.join(n1, "session_id").where((F.col("_n0") >= min_events) & (F.col("_n1") >= min_events))
    return kept.join(ok.select("session_id"), "session_id", "left_semi")


def prefix_samples(plays: DataFrame, n: int = MAX_SEQ_LEN) -> DataFrame:
    """One training sample per play i >= 2: context = the (up to) n plays before i, target = i.

    Written as a bucketed range join instead of a per-session window: plays are bucketed by
    ``play_order div n``; a target looks only at its own and the previous bucket, so each
    join group holds at most 2n rows and a hot session spreads over many tasks.
    Output: session_id, play_order, target_video_id, context (array of video ids, oldest first).
    """
    p = plays.select("session_id", "play_order", "video_id")
    tgt = p.select("session_id", F.col("play_order").alias("t_order"), F.col("video_id").alias("target_video_id"),
                   F.floor(F.col("play_order") / n).alias("_b"))
    ctx = (p.withColumn("_b0", F.floor(F.col("play_order") / n))
           .withColumn("_b", F.explode(F.array(F.col("_b0"), F.col("_b0") + 1))))
    j = (tgt.join(ctx, ["session_id", "_b"])
         .where((F.col("play_order") < F.col("t_order")) & (F.col("play_order") >= F.col("t_order") - n)))
    return (j.groupBy("session_id", "t_order", "target_video_id")
            .agg(F.sort_array(F.collect_list(F.struct("play_order", "video_id"))).alias("_c"))
            .select("session_id", F.col("t_order").alias("play_order"), "target_video_id",
                    F.transform("_c", lambda s: s["video_id"]).alias("context")))


def usable_plays(plays: DataFrame, catalog: DataFrame, unknown: str) -> DataFrame:
    """The plays that training samples are made of, numbered from 1 without gaps.

    ``unknown`` says what a song outside the catalog does: ``"stop"`` ends the session's samples (a
    sample is dropped if any song of its whole prefix, or its target, is unknown: training from
    scratch), ``"skip"`` leaves the play out (retraining on real sessions)."""
    songs = catalog.select("video_id", F.lit(True).alias("_known"))
    marked = plays.join(songs, "video_id", "left").select("session_id", "play_order", "video_id", "liked_flag", F.coalesce("_known", F.lit(False)).alias("_known"))
    if unknown == "skip":
        return numbered(marked.where("_known").select("session_id", F.col("play_order").alias("_at"), "video_id", "liked_flag"), "session_id", ["_at"]).drop("_at")
    if unknown != "stop":
        raise ValueError("unknown must be 'stop' or 'skip'")
    marked = materialise(marked, "marked-plays")
    first = marked.where("not _known").groupBy("session_id").agg(F.min("play_order").alias("_first"))
    out = marked.join(first, "session_id", "left").where("_first is null or play_order < _first")
    return out.select("session_id", "play_order", "video_id", "liked_flag")


def prefix_tensors(plays: DataFrame, catalog: DataFrame, unknown: str = "stop", n: int = MAX_SEQ_LEN, derive=None, block_plays: int = BLOCK_PLAYS) -> DataFrame:
    """W6 whole: one sample per usable play i >= 2. ``input`` is the matrix of the ``n`` plays before
    i, row by row (oldest first), each row embedding ++ [liked flag], with zero rows on the left where
    there are fewer; ``target`` is the embedding of play i. (session_id, play_order, target_video_id,
    rows, width, input array<float>, target array<float>); ``rows`` of the ``n`` rows are plays.

    Plays go to their bucket of numbers, the last ``n`` of a bucket also to the next one. They travel as
    ids: a block of buckets gets the vectors of its songs, each once, and its sorted rows are
    assembled as Arrow arrays. A sample never leaves its bucket, so a session with a third of all plays
    spreads over tasks, and a batch holds a bounded number of samples. ``derive``: ``(function, schema)``,
    what is made of a record batch of samples in the task that assembled it."""
    emb = V.packed(catalog.select("video_id", F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null"), "embedding", "float32")
    size = n * BUCKET_CONTEXTS
    p = materialise(usable_plays(plays, catalog, unknown), "usable-plays").withColumn("_b", F.expr(f"(play_order - 1) div {size}"))
    parts = max(int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // block_plays))
    late = F.expr(f"(play_order - 1) % {size} >= {size - n}")
    placed = p.withColumn("bucket", F.explode(F.when(late, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b")))).withColumn("own", F.col("bucket") == F.col("_b"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("session_id", "bucket"), F.lit(parts)))
    rows = placed.select("block", F.lit(1).alias("late"), "session_id", "bucket", "play_order", "own", "video_id", F.col("liked_flag").cast("float").alias("liked"), F.lit(None).cast("binary").alias("embedding"))
    none = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("session_id", "bucket", "play_order", "own")]
    songs = placed.select("block", "video_id").distinct().join(emb, "video_id").select("block", F.lit(0).alias("late"), *none, "video_id", F.lit(None).cast("float").alias("liked"), "embedding")
    dealt = rows.unionByName(songs).repartition(parts, "block").sortWithinPartitions("block", "late", "session_id", "bucket", "play_order")
    s, v = (dict(rows.dtypes)[c] for c in ("session_id", "video_id"))
    assemble = _assemble(n)
    if derive is None:
        return dealt.mapInArrow(lambda batches: assemble(_with_vectors(batches)), f"session_id {s}, play_order long, target_video_id {v}, rows int, width int, input array<float>, target array<float>")
    function, schema = derive
    return dealt.mapInArrow(lambda batches: map(function, assemble(_with_vectors(batches))), schema)


def _with_vectors(batches):
    """The plays of sorted blocks with the vectors of their songs, which come first in each block; a song
    that has several vectors makes a row of each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    block = names = None
    ids, vectors = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, late = batch.column("block").to_numpy(), batch.column("late").to_numpy()
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (late[1:] != late[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            if blocks[lo] != block:
                block, names, ids, vectors = blocks[lo], None, [], []
            b = batch.slice(lo, hi - lo)
            if not late[lo]:
                ids.append(b.column("video_id"))
                vectors.append(b.column("embedding"))
                continue
            if not ids:
                continue
            if names is None:
                every, vec = pa.concat_arrays(ids), pa.concat_arrays(vectors)
                names = every.unique()
                of = pc.index_in(every, value_set=names).to_numpy()
                count = np.bincount(of, minlength=len(names))
                order, first = np.argsort(of, kind="stable"), np.cumsum(count) - count
            place = pc.index_in(b.column("video_id"), value_set=names)
            row = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            at = place.drop_null().to_numpy()
            again = np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
            song = order[np.repeat(first[at], count[at]) + again]
            row = pa.array(np.repeat(row, count[at]))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in ("session_id", "bucket", "play_order", "own", "video_id", "liked")], vec.take(pa.array(song))],
                                             ["session_id", "bucket", "play_order", "own", "video_id", "liked", "embedding"])


def _assemble(n: int, sample_rows: int = 512):
    """Samples of sorted rows: a row's context are the rows before it in its (session, bucket)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            seen = 0 if tail is None else tail.num_rows
            change = changes(t.column(0)) | changes(t.column(1))
            start = np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))
            # plays without a vector leave gaps: the context are plays of the numbers' own n and the n before
            tens = (np.cumsum(change) << 40) + (t.column(2).to_numpy() - 1) // n
            start = np.maximum(start, np.searchsorted(tens, tens - 1))
            own = t.column(3).to_numpy(zero_copy_only=False).astype(bool)
            vec = V.matrix(t.column(6), "float32")
            full = np.concatenate([vec, t.column(5).to_numpy().astype(np.float32)[:, None]], axis=1)
            at = np.arange(t.num_rows)
            targets = np.flatnonzero(own & (at > start) & (at >= seen))
            for lo in range(0, len(targets), sample_rows):
                i = targets[lo:lo + sample_rows]
                before = i[:, None] + np.arange(-n, 0)[None, :]
                there = before >= start[i][:, None]
                x = np.where(there[:, :, None], full[np.maximum(before, 0)], np.float32(0))
                width = x.shape[2]
                lists = lambda m, w: pa.ListArray.from_arrays(np.arange(0, (len(i) + 1) * w, w, dtype=np.int32), pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [t.column(0).take(pa.array(i)), t.column(2).cast(pa.int64()).take(pa.array(i)), t.column(4).take(pa.array(i)),
                     pa.array(there.sum(axis=1).astype(np.int32)), pa.array(np.full(len(i), width, np.int32)), lists(x, n * width), lists(vec[i], vec.shape[1])],
                    ["session_id", "play_order", "target_video_id", "rows", "width", "input", "target"])
            # the context of the rows to come; rows that are kept are not targets again
            tail = t.slice(max(int(start[-1]), t.num_rows - n))

    return run


def with_sub_session(plays: DataFrame, songs: int = SUB_SESSION_SONGS) -> DataFrame:
    """The number of the sub-session (from 1) that a play belongs to, one per ``songs`` plays."""
    return plays.withColumn("sub_session", F.expr(f"(play_order - 1) div {songs} + 1"))


def split_by_session(df: DataFrame, validation_tenths: int = 1) -> DataFrame:
    """90/10 split by hashed session id (no session in both sets)."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64("session_id"), F.lit(10)) < validation_tenths,
                                         F.lit("validation")).otherwise(F.lit("train")))


def sequence_tensor(plays: DataFrame, catalog: DataFrame, n: int = MAX_SEQ_LEN) -> DataFrame:
    """Per session, the last n known plays as rows embedding ++ [liked_flag], left-padded
    with zero rows to n: (session_id, tensor array<array<double>>, length)."""
    rows = last_n(known_plays(plays, catalog), n).withColumn(
        "_row", F.concat("embedding", F.array(F.col("liked_flag").cast("double"))))
    seq = (rows.groupBy("session_id")
           .agg(F.sort_array(F.collect_list(F.struct("play_order", "_row"))).alias("_s"))
           .withColumn("_rows", F.transform("_s", lambda s: s["_row"])))
    width = F.size(F.element_at("_rows", 1))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(n) - F.size("_rows"))
    return seq.select("session_id", F.concat(pad, "_rows").alias("tensor"), F.size("_rows").alias("length"))


def gru_forward(tensors: DataFrame, weights: dict) -> DataFrame:
    """Batch forward pass of a supplied sequence model over every session, Arrow-batched.

    Architecture (as the reference's): Linear -> LayerNorm -> ReLU -> GRU layers -> Linear ->
    ReLU -> Linear -> L2 unit (inference mode, no dropout). ``weights`` are numpy arrays named
    like a PyTorch state dict; they are a fixed-size model, shipped once per task by closure.
    Output: (session_id, vector array<double>).
    """
    import numpy as np

    w = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}
    n_layers = len([k for k in w if k.startswith("gru.weight_ih_l")])

    def sig(x):
        return 1.0 / (1.0 + np.exp(-x))

    def forward(x):  # x: (B, T, D)
        h = x @ w["input_proj.0.weight"].T + w["input_proj.0.bias"]
        mu, var = h.mean(-1, keepdims=True), h.var(-1, keepdims=True)
        h = (h - mu) / np.sqrt(var + 1e-5) * w["input_proj.1.weight"] + w["input_proj.1.bias"]
        h = np.maximum(h, 0.0)
        for layer in range(n_layers):
            wi, wh = w[f"gru.weight_ih_l{layer}"], w[f"gru.weight_hh_l{layer}"]
            bi, bh = w[f"gru.bias_ih_l{layer}"], w[f"gru.bias_hh_l{layer}"]
            hid = np.zeros((h.shape[0], wh.shape[1]))
            outs = []
            for t in range(h.shape[1]):
                gi = h[:, t] @ wi.T + bi
                gh = hid @ wh.T + bh
                ir, iz, inn = np.split(gi, 3, axis=1)
                hr, hz, hn = np.split(gh, 3, axis=1)
                r, z = sig(ir + hr), sig(iz + hz)
                cand = np.tanh(inn + r * hn)
                hid = (1 - z) * cand + z * hid
                outs.append(hid)
            h = np.stack(outs, axis=1)
        last = h[:, -1]
        o = np.maximum(last @ w["output_proj.0.weight"].T + w["output_proj.0.bias"], 0.0)
        o = o @ w["output_proj.3.weight"].T + w["output_proj.3.bias"]
        nrm = np.linalg.norm(o, axis=1, keepdims=True)
        return np.divide(o, nrm, out=np.zeros_like(o), where=nrm > 0)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.stack(t) for t in pdf["tensor"]])
            y = forward(x)
            yield pd.DataFrame({"session_id": pdf["session_id"], "vector": list(y)})

    return tensors.select("session_id", "tensor").mapInPandas(run, "session_id long, vector array<double>")
