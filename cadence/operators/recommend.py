"""Group recommendation: co-occurrence index, user / group vectors, CBF, CF, sequence signal, hybrid.

All operators take long tables keyed by ``session_id`` and return DataFrames; nothing is
collected. Scale notes per operator are in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.cofilter import Seeds, best_cooccurrence
from cadence.operators.cooccur import pair_counts
from cadence.operators.groupmeans import member_lists, song_places, weighted_means
from cadence.operators.means import vector_means
from cadence.operators.nearest import MetricIndex
from cadence.operators.numbering import numbered
from cadence.session import materialise

# Fixed values that must equal the reference's (recommendation config).
TOP_N = 30
CF_MIN_COOCCURRENCE = 2
SESSION_SCORE_WEIGHT = 0.3
DISLIKE_WEIGHT = 0.5
WEIGHT_CBF_COLD, WEIGHT_CF_COLD = 0.6, 0.4
WEIGHT_CBF_WARM, WEIGHT_CF_WARM, WEIGHT_GRU_WARM = 0.4, 0.3, 0.3
GRU_ACTIVATION_THRESHOLD = 3
GRU_WEIGHT_RAMP = {4: 0.20, 5: 0.25, 6: 0.30}
SESSION_PLAYLIST_USER = "_session_playlist"

# Distinct likes of a user in one list, on average: every user's likes are dealt into chunks of this
# size, so the pairs of a user with many likes spread over many rows.
USER_CHUNK_ITEMS = 500
HOT_LINKS = 1_000          # members of a session whose songs may be unpacked in one task


# --------------------------------------------------------------------------------------
# Population popularity and item-item co-occurrence
# --------------------------------------------------------------------------------------

def popularity(likes: DataFrame, user: str = "user_id", item: str = "video_id") -> DataFrame:
    """Number of distinct users who like each item -> (item, popularity)."""
    return (likes.select(user, item).distinct()
            .groupBy(item).agg(F.count(F.lit(1)).alias("popularity")))


def cooccurrence_pairs(likes: DataFrame, user: str = "user_id", item: str = "video_id",
                       min_count: int = 1, chunk_items: int = USER_CHUNK_ITEMS, **cells) -> DataFrame:
    """A17 upper triangle: (item_a < item_b, cooc) = number of users liking both.

    Exact and skew-safe: likes are de-duplicated, then every user's items are hashed into
    ``ceil(k / chunk_items)`` lists; lists meet in cells that count in a matrix (see ``cooccur``), so a
    user with many likes is spread over many rows and no row per user and pair is made.
    """
    pairs = pair_counts(likes, user, item, chunk_items, **cells)
    if min_count > 1:
        pairs = pairs.where(F.col("cooc") >= min_count)
    return pairs


def cooccurrence_index(likes: DataFrame, user: str = "user_id", item: str = "video_id",
                       min_count: int = 1, chunk_items: int = USER_CHUNK_ITEMS) -> DataFrame:
    """A17 symmetric: (video_id, other_id, cooc), both directions, no self pairs."""
    p = materialise(cooccurrence_pairs(likes, user, item, min_count, chunk_items), "pairs")
    return (p.select(F.col("item_a").alias("video_id"), F.col("item_b").alias("other_id"), "cooc")
            .unionByName(p.select(F.col("item_b").alias("video_id"),
                                  F.col("item_a").alias("other_id"), "cooc")))


# --------------------------------------------------------------------------------------
# Session inputs: F12, U5, J3
# --------------------------------------------------------------------------------------

def in_catalog(df: DataFrame, catalog: DataFrame, item: str = "video_id") -> DataFrame:
    """keep rows whose item exists in the catalog (left semi join)."""
    return df.join(catalog.select(F.col("video_id").alias(item)), item, "left_semi")


def dropped_likes(members: DataFrame, likes: DataFrame, catalog: DataFrame) -> DataFrame:
    """F12's count: per session, the likes of its members that the catalog holds and those that are
    dropped: (session_id, kept, dropped)."""
    songs = catalog.select("video_id", F.lit(True).alias("_in"))
    liked = members.select("session_id", "user_id").distinct().join(likes.select("user_id", "video_id").distinct(), "user_id").join(songs, "video_id", "left")
    return liked.groupBy("session_id").agg(F.count_if(F.col("_in").isNotNull()).alias("kept"), F.count_if(F.col("_in").isNull()).alias("dropped"))


def session_likes(members: DataFrame, likes: DataFrame, catalog: DataFrame,
                  playlist: DataFrame | None = None) -> DataFrame:
    """S13 + F12 + U5: (session_id, user_id, video_id) liked by active members, catalog-filtered,
    plus the session playlist as pseudo-user ``_session_playlist`` (D32)."""
    # distinct sides give distinct pairs; the pairs of a session are many more than its members
    liked = (members.select("session_id", "user_id").distinct()
             .join(in_catalog(likes.select("user_id", "video_id").distinct(), catalog), "user_id")
             .select("session_id", "user_id", "video_id"))
    if playlist is not None:
        liked = liked.unionByName(
            playlist.select("session_id", F.lit(SESSION_PLAYLIST_USER).alias("user_id"), "video_id")
            .distinct())
    return liked


def session_dislikes(members: DataFrame, dislikes: DataFrame) -> DataFrame:
    """(session_id, user_id, video_id) disliked by active members (not catalog-filtered, D32)."""
    return (members.select("session_id", "user_id").distinct()
            .join(dislikes.select("user_id", "video_id").distinct(), "user_id").select("session_id", "user_id", "video_id"))


def exclusions(liked: DataFrame, disliked: DataFrame, played: DataFrame) -> DataFrame:
    """(session_id, video_id) = liked ∪ disliked ∪ played."""
    cols = ["session_id", "video_id"]
    return liked.select(cols).unionByName(disliked.select(cols)).unionByName(played.select(cols)).distinct()


def listed_exclusions(links: DataFrame, owned: DataFrame, own: DataFrame, hot_links: int = HOT_LINKS) -> DataFrame:
    """U3 / J3 as ``exclusions``, distinct ``(session_id, video_id)``: the songs that a session has of its
    ``own(session_id, video_id)`` and of its members, ``links(session_id, owner)`` and ``owned(owner, video_id)``.

    A member's songs travel to the session as one list and are unpacked there. Sessions with more than
    ``hot_links`` members are joined row by row, so that none of them is whole in one task."""
    links = links.select("session_id", "owner").distinct()
    owned = owned.select("owner", "video_id").distinct()
    hot = materialise(links.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_links).select(F.col("session_id").alias("_s")), "hot-sessions")
    v = F.col("video_id")
    none = F.array(F.lit(None).cast(owned.schema["video_id"].dataType))
    songs = F.when(F.count_if(v.isNull()) > 0, F.concat(F.collect_list(v), none)).otherwise(F.collect_list(v))
    lists = owned.groupBy("owner").agg(songs.alias("songs"))
    on = F.col("session_id").eqNullSafe(F.col("_s"))
    some = not hot.isEmpty()
    few, few_own = (x.join(hot, on, "left_anti") if some else x for x in (links, own))
    theirs = few.join(lists, "owner").select("session_id", "songs").unionByName(few_own.select("session_id", F.array("video_id").alias("songs")))
    out = theirs.repartition("session_id").select("session_id", F.explode("songs").alias("video_id")).distinct()
    if some:
        many, many_own = (x.join(hot, on, "left_semi") for x in (links, own))
        rows = many.join(owned, "owner").select("session_id", "video_id").unionByName(many_own.select("session_id", "video_id"))
        out = out.unionByName(rows.distinct())
    return out


# --------------------------------------------------------------------------------------
# Preference vectors
# --------------------------------------------------------------------------------------

def user_preferences(likes: DataFrame, dislikes: DataFrame | None, catalog: DataFrame, keys=("user_id",)) -> DataFrame:
    """A13 per key: unit(mean(liked) - 0.5·mean(disliked)) and liked_count, over catalog songs.

    Keys whose likes are all outside the catalog get no vector (reference skips them). No row carries
    a vector before the means are made."""
    keys = list(keys)
    pos = vector_means(likes.select(*keys, "video_id").distinct(), keys, catalog).select(*keys, F.col("vector").alias("pos"), F.col("n").alias("liked_count"))
    if dislikes is None:
        return pos.select(*keys, V.unit(F.col("pos")).alias("vector"), "liked_count")
    neg = vector_means(dislikes.select(*keys, "video_id").distinct(), keys, catalog).select(*keys, F.col("vector").alias("neg"))
    net = F.when(F.col("neg").isNull(), F.col("pos")).otherwise(
        F.zip_with("pos", "neg", lambda p, n: p - F.lit(DISLIKE_WEIGHT) * n))
    return (pos.join(neg, keys, "left")
            .select(*keys, V.unit(net).alias("vector"), "liked_count"))


def user_vectors(members: DataFrame, likes: DataFrame, dislikes: DataFrame, catalog: DataFrame,
                 playlist: DataFrame | None = None) -> DataFrame:
    """(session_id, user_id, vector, liked_count) of the active members.

    A user's vector does not depend on the session, so it is made once per user and joined to the
    sessions; only the session playlist's pseudo-user (D32) is made per session."""
    m = members.select("session_id", "user_id").distinct()
    users = m.select("user_id").distinct()
    prefs = user_preferences(likes.join(users, "user_id", "left_semi"), dislikes.join(users, "user_id", "left_semi"), catalog)
    out = m.join(prefs, "user_id").select("session_id", "user_id", "vector", "liked_count")
    if playlist is not None:
        own = playlist.select("session_id", F.lit(SESSION_PLAYLIST_USER).alias("user_id"), "video_id")
        out = out.unionByName(user_preferences(own, None, catalog, ("session_id", "user_id")))
    return out


def group_vectors(user_vecs: DataFrame) -> DataFrame:
    """Per session, liked-count-weighted mean of user vectors, L2 unit. Dealt by session first: a
    session has few users, so partial means would be as many and larger than the vectors."""
    return (user_vecs.repartition("session_id").groupBy("session_id")
            .agg(V.vector_mean("vector", "liked_count").alias("vector"))
            .select("session_id", V.unit(F.col("vector")).alias("vector")))


def session_vectors(members: DataFrame, likes: DataFrame, dislikes: DataFrame, catalog: DataFrame, playlist: DataFrame) -> DataFrame:
    """A14 from the inputs of A13, as ``with_fallback_vector(members, group_vectors(user_vectors(..)))``:
    members travel to their sessions as lists of songs, see ``groupmeans``."""
    songs = song_places(catalog)
    if songs is None:
        return with_fallback_vector(members, group_vectors(user_vectors(members, likes, dislikes, catalog, playlist)), catalog)
    m = members.select("session_id", "user_id").distinct()
    users = m.select("user_id").distinct()
    liked, disliked = likes.join(users, "user_id", "left_semi"), dislikes.join(users, "user_id", "left_semi")
    pos, neg = (vector_means(x.select("user_id", "video_id").distinct(), ["user_id"], catalog) for x in (liked, disliked))
    prefs = pos.select("user_id", F.col("vector").alias("pos"), F.col("n").alias("liked_count")).join(
        neg.select("user_id", F.col("vector").alias("neg"), F.col("n").alias("disliked_count")), "user_id", "left")
    rows = m.join(member_lists(prefs, liked, disliked, songs), "user_id").drop("user_id")
    own = vector_means(playlist.select("session_id", "video_id").distinct(), ["session_id"], catalog)
    none = F.lit(None).cast("binary")
    own = V.packed(own.select("session_id", F.col("n").cast("double").alias("weight"), F.lit(0.0).alias("own"), F.lit(0.0).alias("other"),
                              none.alias("liked"), none.alias("disliked"), V.unit(F.col("vector")).alias("vector")), "vector")
    means = weighted_means(rows.unionByName(own), m.select("session_id").distinct(), members.count(), songs)
    return means.select("session_id", F.coalesce(V.unit(F.col("vector")), catalog_mean_vector(catalog).scalar()).alias("vector"))


def catalog_mean_vector(catalog: DataFrame) -> DataFrame:
    """One-row frame with the catalog-average embedding (fallback group vector)."""
    return catalog.agg(V.vector_mean("embedding").alias("vector"))


def with_fallback_vector(sessions: DataFrame, group_vecs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every session gets a vector: its group vector, else the catalog average.

    The catalog average is a one-row aggregate, joined through a scalar subquery, so no
    session data moves to it.
    """
    mean_vec = catalog_mean_vector(catalog).scalar()
    return (sessions.select("session_id").distinct()
            .join(group_vecs, "session_id", "left")
            .select("session_id", F.coalesce(F.col("vector"), mean_vec).alias("vector")))


# --------------------------------------------------------------------------------------
# Session feedback scores normalised by max |score| in the session
# --------------------------------------------------------------------------------------

def normalized_session_scores(track_scores: DataFrame) -> DataFrame:
    """(session_id, video_id, session_score) = score / max(|score|) per session, 0 if all zero."""
    per_session = track_scores.groupBy("session_id").agg(F.max(F.abs("score")).alias("_m"))
    return (track_scores.join(per_session, "session_id")
            .select("session_id", "video_id",
                    F.when(F.col("_m") == 0, F.lit(0.0))
                    .otherwise(F.col("score") / F.col("_m")).alias("session_score")))


# --------------------------------------------------------------------------------------
# Exhaustive top-k cosine (the pruned form, J10, is in ``nearest``) and cosine of given pairs
# --------------------------------------------------------------------------------------

TOPK_QUERY_ROWS, TOPK_ITEM_ROWS = 2_000, 20_000     # rows of one matrix product, on average


def _block_topk_fn(k: int, ids: list[str], sub_rows: int = 256):
    """Top rows of one (sessions, items) block by (score desc, id asc), each session cut at its
    own length; scores of equal vectors are made equal (12 decimals) so ties fall to the id."""
    import numpy as np
    import pandas as pd

    def unit(column):
        m = np.stack(column.to_numpy()).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if q.empty or items.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*ids, "score"]})
        items = items.sort_values("video_id", kind="stable")     # so that position order is id order
        qm, im, names = unit(q["vector"]), unit(items["embedding"]), items["video_id"].to_numpy()
        take = np.minimum(k + q["k_extra"].to_numpy().astype(np.int64), len(names))
        who, what, score = [], [], []
        for lo in range(0, len(qm), sub_rows):
            sims = np.round(qm[lo:lo + sub_rows] @ im.T, 12)
            for i, row in enumerate(sims, lo):
                n = int(take[i])
                if n < len(row):
                    cut = np.partition(row, len(row) - n)[len(row) - n]
                    best = np.flatnonzero(row > cut)
                    best = np.concatenate([best, np.flatnonzero(row == cut)[:n - len(best)]])
                else:
                    best = np.arange(len(row))
                who.append(np.full(len(best), i))
                what.append(best)
                score.append(row[best])
        who = np.concatenate(who)
        return pd.DataFrame({ids[0]: q["session_id"].to_numpy()[who], ids[1]: names[np.concatenate(what)], "score": np.concatenate(score)})

    return run


def topk_cosine(queries: DataFrame, catalog: DataFrame, k: int, query_rows: int = TOPK_QUERY_ROWS,
                item_rows: int = TOPK_ITEM_ROWS) -> DataFrame:
    """Per session, the ``k + k_extra`` catalog items with the highest cosine to ``vector``, ties
    by id; ids of any orderable type.

    ``queries``: (session_id, vector, k_extra). Both sides are hashed into blocks whose number
    follows their row counts (scalar subqueries, no job while planning), so a (block, chunk) group
    holds about ``query_rows`` x ``item_rows`` whatever the data's size, and is worked through
    some sessions at a time. Neither side is broadcast, no cross join is planned and only O(k)
    rows per session leave a task. Exact: the union of per-chunk top lists contains the top list.
    """
    types = [queries.schema["session_id"].dataType.simpleString(), catalog.schema["video_id"].dataType.simpleString()]

    def blocks(df: DataFrame, rows: int):
        return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1)).cast("int")).scalar()

    n_q, n_i = blocks(queries.select("session_id"), query_rows), blocks(catalog.select("video_id"), item_rows)
    q = (queries.select("session_id", V.as_double_array("vector").alias("vector"),
                        F.col("k_extra").cast("long").alias("k_extra"))
         .withColumn("_blk", F.pmod(F.xxhash64("session_id"), n_q).cast("int"))
         .withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_i - 1))))
    items = (catalog.select("video_id", V.as_double_array("embedding").alias("embedding"))
             .withColumn("_chunk", F.pmod(F.xxhash64("video_id"), n_i).cast("int"))
             .withColumn("_blk", F.explode(F.sequence(F.lit(0), n_q - 1))))
    return (q.groupBy("_blk", "_chunk").cogroup(items.groupBy("_blk", "_chunk"))
            .applyInPandas(_block_topk_fn(k, ["session_id", "video_id"]),
                           f"session_id {types[0]}, video_id {types[1]}, score double")
            # per-chunk lists are merged, then cut to each session's own length
            .withColumn("_r", F.row_number().over(
                Window.partitionBy("session_id").orderBy(F.desc("score"), "video_id"))))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, catalog: DataFrame, name: str = "score") -> DataFrame:
    """Cosine for explicit (session_id, video_id) pairs (frontier-sized; HOF, JVM-side)."""
    emb = catalog.select("video_id", V.as_double_array("embedding").alias("_e"))
    return (pairs.join(vectors.select("session_id", V.as_double_array("vector").alias("_v")), "session_id")
            .join(emb, "video_id")
            .withColumn(name, V.cosine(F.col("_v"), F.col("_e"))).drop("_v", "_e"))


# --------------------------------------------------------------------------------------
# Content-based top-k
# --------------------------------------------------------------------------------------

def cbf_scores(vectors: DataFrame, excluded: DataFrame, session_scores: DataFrame,
               catalog: DataFrame | MetricIndex, k: int = TOP_N, shared: tuple[DataFrame, DataFrame] | None = None, **search) -> DataFrame:
    """Per session top-k of cbf_score + 0.3·session_score over catalog minus exclusions.
    ``shared``: exclusions by owner, see ``MetricIndex.top_items``.

    Excluded and feedback-nudged songs are marks of the index search, so no session hands on more
    than k rows; ``excluded`` need not be distinct. ``catalog``: the songs, or an index of them that several searches share.
    Output: session_id, video_id, cbf_score, session_score, final_score, rank.
    """
    index = catalog if isinstance(catalog, MetricIndex) else MetricIndex(catalog)
    marks = (excluded.select("session_id", "video_id", F.lit(True).alias("excluded"), F.lit(0.0).alias("bonus"))
             .unionByName(session_scores.select("session_id", "video_id", F.lit(False).alias("excluded"),
                                                F.col("session_score").alias("bonus"))))
    best = index.top_items(vectors, k, marks, weight=SESSION_SCORE_WEIGHT, shared=shared, **search)
    return best.select("session_id", "video_id", F.col("score").alias("cbf_score"), F.col("bonus").alias("session_score"),
                       F.col("total").alias("final_score"), "rank")


def top_n(df: DataFrame, score: str, k: int = TOP_N, key: str = "session_id") -> DataFrame:
    """1-based rank per session by score desc, video_id asc (D19); keep rank <= k.

    Spark plans this as a window-group-limit, which prunes each partition before the sort.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc("video_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------------------
# Collaborative filtering with per-session playlist delta and embedding fallback
# --------------------------------------------------------------------------------------

def _checked(seeds: DataFrame | Seeds, playlist: DataFrame | None, min_cooccurrence: int) -> Seeds:
    if playlist is not None and min_cooccurrence < 2:
        raise ValueError("the playlist delta needs min_cooccurrence >= 2 (pairs absent from the index stay below it)")
    return seeds if isinstance(seeds, Seeds) else Seeds(seeds)


def cf_cooccurrence_scores(seeds: DataFrame | Seeds, index: DataFrame, pop: DataFrame,
                           played: DataFrame, playlist: DataFrame | None = None,
                           min_cooccurrence: int = CF_MIN_COOCCURRENCE,
                           catalog: DataFrame | None = None, k: int | None = None, **cells) -> DataFrame:
    """R2: per session ``(session_id, video_id, cf_score, rank)`` of the candidates with a non-zero
    score, ranked by score and id (W2); with ``k`` the ``k`` best.

    score(c) = min(max_{g in seeds, cooc'(c,g) >= min} cooc'(c,g) / max(pop'(c), 1), 1), where
    the primes add the session playlist as one more population user (U5) without rebuilding
    the index: +1 for pairs inside the playlist, +1 popularity for playlist songs. The maximum is
    taken in cells (see ``cofilter``): no row per session, seed and partner is made. Candidates
    are the songs of ``catalog`` (where given) minus played songs; all others score 0 (no row).
    """
    found, whole = best_cooccurrence(_checked(seeds, playlist, min_cooccurrence), index, pop, played, playlist, min_cooccurrence, catalog, k=k, **cells)
    if whole:
        return found
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("cf_score"), "video_id"))
    out = found.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def cf_top_n(scores: DataFrame, sessions: DataFrame, played: DataFrame, catalog: DataFrame, k: int = TOP_N) -> DataFrame:
    """R2 + W2: the ``k`` best candidates per session of ``sessions``, ties and songs without a score
    (0) by id: (session_id, video_id, cf_score, rank). Candidates are the catalog minus played songs.

    Songs that score 0 are only looked up for sessions with fewer than ``k`` scores, and there only as
    many of the smallest ids as can be needed: k, and one for each played or scored song."""
    best = materialise(top_n(scores.select("session_id", "video_id", "cf_score"), "cf_score", k).drop("rank"), "cf-best")
    seen = best.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    n_played = played.select("session_id", "video_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("_p"))
    short = (sessions.select("session_id").distinct().join(seen, "session_id", "left").fillna(0, ["_n"]).where(F.col("_n") < k)
             .join(n_played, "session_id", "left").fillna(0, ["_p"]))
    need = short.select("session_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") + F.col("_p") + k)).alias("_i"))
    songs = numbered(catalog.select(F.lit(0).alias("_all"), "video_id").distinct(), "_all", ["video_id"], "_i").select("_i", "video_id")
    zeros = (need.join(songs, "_i").select("session_id", "video_id")
             .join(played.select("session_id", "video_id"), ["session_id", "video_id"], "left_anti")
             .join(best.select("session_id", "video_id"), ["session_id", "video_id"], "left_anti").withColumn("cf_score", F.lit(0.0)))
    return top_n(best.unionByName(zeros), "cf_score", k)


def cf_fallback_vectors(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """R3 helper: per session, unweighted mean embedding of the distinct seed songs in catalog."""
    return vector_means(seeds.select("session_id", "video_id").distinct(), ["session_id"], catalog).select("session_id", "vector")


def cf_for_candidates(candidates: DataFrame, seeds: DataFrame | Seeds, index: DataFrame, pop: DataFrame,
                      played: DataFrame, catalog: DataFrame, playlist: DataFrame | None = None,
                      min_cooccurrence: int = CF_MIN_COOCCURRENCE, **cells) -> DataFrame:
    """R2 + R3 for given (session_id, video_id) candidates (the hybrid's base set).

    Co-occurrence as in ``cf_cooccurrence_scores``, of the candidates only; the same cells say whether
    any unplayed song of the catalog scores. Sessions with seeds but no such signal use
    (cos(mean seed, c) + 1) / 2; sessions without seeds score 0 (CF returns nothing there).
    """
    seeds = _checked(seeds, playlist, min_cooccurrence)
    cand = candidates.select("session_id", "video_id").distinct()
    found, _ = best_cooccurrence(seeds, index, pop, played, playlist, min_cooccurrence, catalog, cand, **cells)
    found = materialise(found.drop("rank"), "cf-candidates")
    co = found.where("video_id is not null")
    has_co = found.where("video_id is null").select("session_id").distinct()
    silent = materialise(seeds.sessions().join(has_co, "session_id", "left_anti"), "cf-silent")      # R3: seeds without a signal
    fb = pair_cosine(cand.join(silent, "session_id", "left_semi"), cf_fallback_vectors(seeds.rows(silent), catalog), catalog, "_cos")
    return (cand.join(co, ["session_id", "video_id"], "left")
            .join(silent.withColumn("_silent", F.lit(True)), "session_id", "left")
            .join(fb.select("session_id", "video_id", "_cos"), ["session_id", "video_id"], "left")
            .select("session_id", "video_id",
                    F.when(F.col("_silent"), (F.coalesce("_cos", F.lit(0.0)) + 1.0) / 2.0)
                    .otherwise(F.coalesce("cf_score", F.lit(0.0))).alias("cf_score")))


# --------------------------------------------------------------------------------------
# Hybrid merge
# --------------------------------------------------------------------------------------

def gru_weight_expr(songs_played: Column, gru_active: Column, documented_ramp: bool = False) -> Column:
    """Ramp {4: .20, 5: .25, 6: .30}, other -> .30, inactive -> 0."""
    w = F.lit(WEIGHT_GRU_WARM)
    for n in sorted(GRU_WEIGHT_RAMP, reverse=True):
        w = F.when(songs_played == n, F.lit(GRU_WEIGHT_RAMP[n])).otherwise(w)
    if documented_ramp:
        w = F.when(songs_played < 4, F.lit(0.0)).otherwise(w)
    return F.when(gru_active, w).otherwise(F.lit(0.0))


def phase_name_expr(songs_played: Column, gru_active: Column) -> Column:
    """P20: cold_start / gru_soft_entry / gru_growing / full_hybrid."""
    w = gru_weight_expr(songs_played, F.lit(True))
    return (F.when(~gru_active, F.lit("cold_start"))
            .when(w == 0.20, F.lit("gru_soft_entry"))
            .when(w == 0.25, F.lit("gru_growing"))
            .otherwise(F.lit("full_hybrid")))


def active_weights_expr(gru_active: Column, gru_w: Column) -> Column:
    """struct(cbf, cf, gru) of the normalised weights, 4 dp."""
    cold = (~gru_active) | (gru_w == 0)
    total = F.lit(WEIGHT_CBF_WARM + WEIGHT_CF_WARM) + gru_w
    cold_total = WEIGHT_CBF_COLD + WEIGHT_CF_COLD
    return F.struct(
        F.when(cold, F.lit(round(WEIGHT_CBF_COLD / cold_total, 4)))
        .otherwise(F.round(F.lit(WEIGHT_CBF_WARM) / total, 4)).alias("cbf"),
        F.when(cold, F.lit(round(WEIGHT_CF_COLD / cold_total, 4)))
        .otherwise(F.round(F.lit(WEIGHT_CF_WARM) / total, 4)).alias("cf"),
        F.when(cold, F.lit(0.0)).otherwise(F.round(gru_w / total, 4)).alias("gru"))


def hybrid(cbf: DataFrame, cf: DataFrame, gru: DataFrame | None, session_state: DataFrame,
           k: int = TOP_N) -> DataFrame:
    """Merge on the CBF base set (J4): missing CF / sequence scores are 0.

    ``session_state``: (session_id, songs_played, gru_active). Cold: .6/.4 normalised; warm:
    .4/.3/ramp normalised by their sum; plus 0.3·session_score; top-k by final score.
    """
    base = cbf.select("session_id", "video_id", "cbf_score", "session_score")
    out = base.join(cf.select("session_id", "video_id", "cf_score"), ["session_id", "video_id"], "left")
    if gru is not None:
        out = out.join(gru.select("session_id", "video_id", "gru_score"), ["session_id", "video_id"], "left")
    else:
        out = out.withColumn("gru_score", F.lit(None).cast("double"))
    st = session_state.select("session_id", "songs_played", "gru_active")
    out = (out.join(st, "session_id", "left")
           .withColumn("songs_played", F.coalesce("songs_played", F.lit(0)))
           .withColumn("gru_active", F.coalesce("gru_active", F.lit(False)))
           .withColumn("gru_weight", gru_weight_expr(F.col("songs_played"), F.col("gru_active")))
           .withColumn("cf_score", F.coalesce("cf_score", F.lit(0.0))))
    # the sequence branch is used only when active with a positive weight and it returned rows
    has_gru = gru.select("session_id").distinct().withColumn("_hg", F.lit(True)) if gru is not None else None
    if has_gru is not None:
        out = out.join(has_gru, "session_id", "left")
    else:
        out = out.withColumn("_hg", F.lit(None).cast("boolean"))
    warm = F.col("gru_active") & (F.col("gru_weight") > 0) & F.col("_hg").isNotNull()
    total = F.lit(WEIGHT_CBF_WARM + WEIGHT_CF_WARM) + F.col("gru_weight")
    cold_total = WEIGHT_CBF_COLD + WEIGHT_CF_COLD
    out = (out.withColumn("gru_score", F.when(warm, F.coalesce("gru_score", F.lit(0.0))).otherwise(F.lit(0.0)))
           .withColumn("final_score", F.when(
               warm,
               F.lit(WEIGHT_CBF_WARM) / total * F.col("cbf_score")
               + F.lit(WEIGHT_CF_WARM) / total * F.col("cf_score")
               + F.col("gru_weight") / total * F.col("gru_score"))
               .otherwise(F.lit(WEIGHT_CBF_COLD / cold_total) * F.col("cbf_score")
                          + F.lit(WEIGHT_CF_COLD / cold_total) * F.col("cf_score"))
               + F.lit(SESSION_SCORE_WEIGHT) * F.col("session_score")))
    return top_n(out.drop("_hg", "rank"), "final_score", k)
