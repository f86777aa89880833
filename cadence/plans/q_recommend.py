"""Recommendation queries: A13-A17, F12, J3, J10, R1-R4, R7, R8, U3-U5, W1, W2, W9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators import recommend as R
from cadence.operators.nearest import MetricIndex
from cadence.operators import prefs as P
from cadence.operators import sinks
from cadence.operators.snapshots import recommendation_snapshots
from cadence.plans.adapters import Adapters, with_ctes
from cadence.plans.registry import register
from cadence.session import materialise, scratch


def r4(c):
    """Round to 4 dp the way the SQL engines do (see ``scalars.round_to``)."""
    from cadence.functions.scalars import round_to
    return round_to(c, 4)


def s4(x: str) -> str:
    return f"(round({x}, 4) + 0.0)"


# ---------------------------------------------------------------------------------------
# shared plan pieces
# ---------------------------------------------------------------------------------------

class SessionInputs:
    """All per-session inputs of a recommendation cycle.

    With ``write`` the ones that a cycle uses again and again are written once to the shared
    checkpoint folder and scanned from there, instead of being planned anew at each use."""

    def __init__(self, spark: SparkSession, sf_dir: str, write: bool = False):
        a = Adapters(spark, sf_dir)
        keep = materialise if write else (lambda df, name: df)
        self.a = a
        self.keep = keep
        self._songs = self._liked = None
        self.catalog = keep(a.catalog(), "catalog")
        self.members = a.members()
        self.likes = keep(a.likes(), "likes")
        self.dislikes = a.dislikes()
        self.playlist = keep(a.playlist(), "playlist")
        self.played = a.played()
        self.disliked = R.session_dislikes(self.members, self.dislikes)
        self.session_scores = keep(R.normalized_session_scores(
            P.track_scores(P.with_feedback_weight(a.votes()))), "session-scores")

    @property
    def liked(self) -> DataFrame:
        """U5, one row per session, member and song: many more than members or likes."""
        if self._liked is None:
            self._liked = self.keep(R.session_likes(self.members, self.likes, self.catalog, self.playlist), "liked")
        return self._liked

    def user_vectors(self) -> DataFrame:
        return R.user_vectors(self.members, self.likes, self.dislikes, self.catalog, self.playlist)

    def group_vectors(self) -> DataFrame:
        return self.keep(R.session_vectors(self.members, self.likes, self.dislikes, self.catalog, self.playlist), "group-vectors")

    def cbf(self, k: int = R.TOP_N, write: bool = True) -> DataFrame:
        out = R.cbf_scores(self.group_vectors(), self.left_out(), self.session_scores, self.songs(), k, shared=self.shared())
        return self.keep(out, "cbf") if write else out

    @property
    def excluded(self) -> DataFrame:
        """J3 as a set: likes count where the catalog holds the song, dislikes and plays always."""
        links, likes = self.shared()[0], R.in_catalog(self.likes, self.catalog)
        cols = [F.col("user_id").alias("owner"), "video_id"]
        return R.listed_exclusions(links, likes.select(cols).unionByName(self.dislikes.select(cols)), self.left_out())

    def left_out(self) -> DataFrame:
        """J3's songs of the session itself, repeats included: the search needs no distinct rows."""
        cols = ["session_id", "video_id"]
        return self.playlist.select(cols).unionByName(self.played.select(cols))

    def shared(self) -> tuple[DataFrame, DataFrame]:
        """J3's songs of the members, one list per user for all sessions."""
        cols = [F.col("user_id").alias("owner"), "video_id"]
        return self.members.select("session_id", F.col("user_id").alias("owner")), self.likes.select(cols).unionByName(self.dislikes.select(cols))

    def seeds(self) -> R.Seeds:
        """U5 as lists per user and the session's playlist, see ``liked``."""
        owned = R.in_catalog(self.likes.select(F.col("user_id").alias("owner"), "video_id"), self.catalog)
        return R.Seeds(self.playlist.select("session_id", "video_id"), self.members.select("session_id", F.col("user_id").alias("owner")), owned)

    def songs(self) -> MetricIndex:
        """The index of the catalog, built once per cycle."""
        if self._songs is None:
            self._songs = MetricIndex(self.catalog)
        return self._songs

    def index(self):
        return self.keep(R.cooccurrence_index(self.likes), "cooccurrence"), self.keep(R.popularity(self.likes), "popularity")

    def predicted(self) -> DataFrame:
        """R4 input: the default sequence model's predicted vector per active session."""
        from cadence.operators.sequences import recent_mean_model
        st = self.a.session_state()
        return recent_mean_model(self.a.plays(), self.catalog, st)


SQL_SESSION = [
    ("s_liked", """
        SELECT DISTINCT m.session_id, m.user_id, l.video_id FROM members m JOIN likes l ON m.user_id = l.user_id
        WHERE l.video_id IN (SELECT video_id FROM catalog)
        UNION SELECT DISTINCT session_id, '_session_playlist' AS user_id, video_id FROM playlist"""),
    ("s_disliked", """
        SELECT DISTINCT m.session_id, m.user_id, d.video_id FROM members m JOIN dislikes d ON m.user_id = d.user_id"""),
    ("excl", """
        SELECT session_id, video_id FROM s_liked UNION SELECT session_id, video_id FROM s_disliked
        UNION SELECT session_id, video_id FROM played"""),
    ("tscore", """
        SELECT session_id, video_id, sum(CASE lower(action) WHEN 'like' THEN 2.0 WHEN 'dislike' THEN -2.0
               WHEN 'skip' THEN -0.5 WHEN 'replay' THEN 1.5 ELSE 0.0 END) AS score FROM votes GROUP BY ALL"""),
    ("sscore", """
        SELECT t.session_id, t.video_id,
               CASE WHEN m.mx = 0 THEN 0.0 ELSE t.score / m.mx END AS session_score
        FROM tscore t JOIN (SELECT session_id, max(abs(score)) AS mx FROM tscore GROUP BY ALL) m USING (session_id)"""),
]

SQL_VECTORS = [
    ("pos_d", """
        SELECT session_id, user_id, i, avg(x) AS p FROM (
          SELECT s.session_id, s.user_id, unnest(c.embedding) AS x, generate_subscripts(c.embedding, 1) AS i
          FROM s_liked s JOIN catalog c ON s.video_id = c.video_id) GROUP BY ALL"""),
    ("liked_n", """
        SELECT s.session_id, s.user_id, count(*) AS liked_count
        FROM s_liked s JOIN catalog c ON s.video_id = c.video_id GROUP BY ALL"""),
    ("neg_d", """
        SELECT session_id, user_id, i, avg(x) AS n FROM (
          SELECT s.session_id, s.user_id, unnest(c.embedding) AS x, generate_subscripts(c.embedding, 1) AS i
          FROM s_disliked s JOIN catalog c ON s.video_id = c.video_id) GROUP BY ALL"""),
    ("net_d", """
        SELECT p.session_id, p.user_id, p.i, CASE WHEN n.n IS NULL THEN p.p ELSE p.p - 0.5 * n.n END AS v
        FROM pos_d p LEFT JOIN neg_d n USING (session_id, user_id, i)"""),
    ("unorm", "SELECT session_id, user_id, sqrt(sum(v * v)) AS nrm FROM net_d GROUP BY ALL"),
    ("uvec_d", """
        SELECT d.session_id, d.user_id, d.i, CASE WHEN u.nrm > 0 THEN d.v / u.nrm ELSE d.v END AS v
        FROM net_d d JOIN unorm u USING (session_id, user_id)"""),
    ("gsum_d", """
        SELECT d.session_id, d.i, sum(d.v * n.liked_count) / sum(n.liked_count) AS g
        FROM uvec_d d JOIN liked_n n USING (session_id, user_id) GROUP BY ALL"""),
    ("gnorm", "SELECT session_id, sqrt(sum(g * g)) AS nrm FROM gsum_d GROUP BY ALL"),
    ("gvec", """
        SELECT d.session_id, list(CASE WHEN n.nrm > 0 THEN d.g / n.nrm ELSE d.g END ORDER BY d.i) AS vector
        FROM gsum_d d JOIN gnorm n USING (session_id) GROUP BY d.session_id"""),
    ("cmean", """
        SELECT list(m ORDER BY i) AS vector FROM (
          SELECT i, avg(x) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
          FROM catalog) GROUP BY i)"""),
    ("svec", """
        SELECT s.session_id, coalesce(g.vector, (SELECT vector FROM cmean)) AS vector
        FROM (SELECT DISTINCT session_id FROM members) s LEFT JOIN gvec g USING (session_id)"""),
]

SQL_CBF = [
    ("cbf_all", """
        SELECT v.session_id, c.video_id, c.genre, list_cosine_similarity(v.vector, c.embedding) AS cbf_score
        FROM svec v CROSS JOIN catalog c
        WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.session_id = v.session_id AND e.video_id = c.video_id)"""),
    ("cbf_scored", """
        SELECT a.session_id, a.video_id, a.genre, a.cbf_score, coalesce(s.session_score, 0.0) AS session_score,
               a.cbf_score + 0.3 * coalesce(s.session_score, 0.0) AS final_score
        FROM cbf_all a LEFT JOIN sscore s USING (session_id, video_id)"""),
    ("cbf", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final_score DESC, video_id) AS rank
                       FROM cbf_scored) WHERE rank <= 30"""),
]

SQL_INDEX = [
    ("pop", "SELECT video_id, count(*) AS popularity FROM likes GROUP BY video_id"),
    ("idx", """
        SELECT a.video_id, b.video_id AS other_id, count(*) AS cooc
        FROM likes a JOIN likes b ON a.user_id = b.user_id AND a.video_id <> b.video_id GROUP BY ALL"""),
]

SQL_CF = [
    ("seeds", "SELECT DISTINCT session_id, video_id AS seed FROM s_liked"),
    ("cf_hits", """
        SELECT s.session_id, i.video_id, s.seed,
               i.cooc + CASE WHEN pc.video_id IS NOT NULL AND pg.video_id IS NOT NULL THEN 1 ELSE 0 END AS cooc
        FROM seeds s JOIN idx i ON i.other_id = s.seed AND i.video_id IN (SELECT video_id FROM catalog)
        LEFT JOIN playlist pc ON pc.session_id = s.session_id AND pc.video_id = i.video_id
        LEFT JOIN playlist pg ON pg.session_id = s.session_id AND pg.video_id = s.seed"""),
    ("cf_best", """
        SELECT h.session_id, h.video_id, max(h.cooc) AS raw FROM cf_hits h WHERE h.cooc >= 2 GROUP BY ALL"""),
    ("cf", """
        SELECT b.session_id, b.video_id,
               least(b.raw / greatest(coalesce(p.popularity, 0) + CASE WHEN pl.video_id IS NULL THEN 0 ELSE 1 END, 1), 1.0)
               AS cf_score
        FROM cf_best b LEFT JOIN pop p ON p.video_id = b.video_id
        LEFT JOIN playlist pl ON pl.session_id = b.session_id AND pl.video_id = b.video_id
        WHERE NOT EXISTS (SELECT 1 FROM played x WHERE x.session_id = b.session_id AND x.video_id = b.video_id)"""),
]

_BASE = ["catalog", "members", "likes", "dislikes", "playlist", "played", "votes"]


# ---------------------------------------------------------------------------------------
# A16 / A17 / J6
# ---------------------------------------------------------------------------------------

@register("a16_song_popularity", with_ctes(["likes"], [], """
    SELECT video_id, count(*) AS popularity FROM likes GROUP BY video_id"""))
def a16_song_popularity(spark, sf_dir):
    return R.popularity(Adapters(spark, sf_dir).likes())


@register("a17_cooccurrence", with_ctes(["likes"], SQL_INDEX[1:], "SELECT * FROM idx"))
def a17_cooccurrence(spark, sf_dir):
    return R.cooccurrence_index(Adapters(spark, sf_dir).likes())


@register("j6_cooccurrence_pairs_min2", with_ctes(["likes"], [], """
    SELECT a.video_id AS item_a, b.video_id AS item_b, count(*) AS cooc
    FROM likes a JOIN likes b ON a.user_id = b.user_id AND a.video_id < b.video_id
    GROUP BY ALL HAVING count(*) >= 2"""))
def j6_cooccurrence_pairs_min2(spark, sf_dir):
    return R.cooccurrence_pairs(Adapters(spark, sf_dir).likes(), min_count=2)


# ---------------------------------------------------------------------------------------
# R2: CF scores for every candidate with a signal, ranked
# ---------------------------------------------------------------------------------------

def _cf_query(spark, sf_dir):
    si = SessionInputs(spark, sf_dir, write=True)
    idx, pop = si.index()
    cf = R.cf_cooccurrence_scores(si.seeds(), idx, pop, si.played, si.playlist, catalog=si.catalog)
    return cf.select("session_id", "video_id", r4(F.col("cf_score")).alias("cf_score"), "rank")


register("r2_cf_scores", with_ctes(_BASE, SQL_SESSION[:2] + SQL_INDEX + SQL_CF, f"""
    SELECT session_id, video_id, {s4('cf_score')} AS cf_score,
           row_number() OVER (PARTITION BY session_id ORDER BY cf_score DESC, video_id) AS rank
    FROM cf"""))(_cf_query)


@register("r2_cf_topn", with_ctes(_BASE, SQL_SESSION[:2] + SQL_INDEX + SQL_CF + [("cand", """
        SELECT s.session_id, c.video_id, coalesce(cf.cf_score, 0.0) AS cf_score
        FROM (SELECT DISTINCT session_id FROM seeds) s CROSS JOIN catalog c LEFT JOIN cf USING (session_id, video_id)
        WHERE NOT EXISTS (SELECT 1 FROM played x WHERE x.session_id = s.session_id AND x.video_id = c.video_id)""")], f"""
    SELECT session_id, video_id, {s4('cf_score')} AS cf_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cf_score DESC, video_id) AS rank FROM cand) WHERE rank <= 30"""))
def r2_cf_topn(spark, sf_dir):
    si = SessionInputs(spark, sf_dir, write=True)
    idx, pop = si.index()
    seeds = si.seeds()
    cf = R.cf_cooccurrence_scores(seeds, idx, pop, si.played, si.playlist, catalog=si.catalog, k=R.TOP_N)
    top = R.cf_top_n(cf, seeds.sessions(), si.played, si.catalog)
    return top.select("session_id", "video_id", r4(F.col("cf_score")).alias("cf_score"), F.col("rank").cast("long").alias("rank"))


@register("f12_dropped_likes", with_ctes(["ncat", "members"], [("raw_likes", """
        SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, l_partkey AS video_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")], """
    SELECT session_id, count(*) FILTER (WHERE video_id < (SELECT n FROM ncat)) AS kept, count(*) FILTER (WHERE video_id >= (SELECT n FROM ncat)) AS dropped
    FROM (SELECT m.session_id, m.user_id, l.video_id FROM members m JOIN raw_likes l USING (user_id)) GROUP BY 1"""))
def f12_dropped_likes(spark, sf_dir):
    """Likes by part, of which the catalog holds those below its size."""
    a = Adapters(spark, sf_dir)
    likes = a._order_lines().select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").alias("video_id"))
    return R.dropped_likes(a.members(), likes, a.catalog())


# ---------------------------------------------------------------------------------------
# A13 / A14 / A15 vectors (reported as norm check + element sum + first element)
# ---------------------------------------------------------------------------------------

def _vec_summary(df: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    v = F.col("vector")
    return df.select(*keys, *extra,
                     F.array_join(F.transform(v, lambda x: F.format_string("%.4f", x)), " ").alias("vector"),
                     r4(V.norm(v)).alias("vec_norm"),
                     r4(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                     r4(F.element_at(v, 1)).alias("vec_first"))


@register("a13_user_vectors", with_ctes(_BASE, SQL_SESSION[:2] + SQL_VECTORS[:6], f"""
    SELECT d.session_id, d.user_id, n.liked_count, {s4('sqrt(sum(d.v * d.v))')} AS vec_norm,
           {s4('sum(d.v)')} AS vec_sum, {s4('max(CASE WHEN d.i = 1 THEN d.v END)')} AS vec_first,
           string_agg(printf('%.4f', d.v), ' ' ORDER BY d.i) AS vector
    FROM uvec_d d JOIN liked_n n USING (session_id, user_id) GROUP BY d.session_id, d.user_id, n.liked_count"""))
def a13_user_vectors(spark, sf_dir):
    si = SessionInputs(spark, sf_dir)
    uv = si.user_vectors()
    return _vec_summary(uv, ["session_id", "user_id"], ["liked_count"])


@register("a14_group_vectors", with_ctes(_BASE, SQL_SESSION[:2] + SQL_VECTORS, f"""
    SELECT session_id, {s4('sqrt(list_sum(list_transform(vector, lambda x: x * x)))')} AS vec_norm,
           {s4('list_sum(vector)')} AS vec_sum, {s4('vector[1]')} AS vec_first,
           array_to_string(list_transform(vector, lambda x: printf('%.4f', x)), ' ') AS vector FROM svec"""))
def a14_group_vectors(spark, sf_dir):
    si = SessionInputs(spark, sf_dir)
    return _vec_summary(si.group_vectors(), ["session_id"], [])


@register("a15_catalog_mean_vector", with_ctes(["catalog"], SQL_VECTORS[9:10], f"""
    SELECT {s4('list_sum(vector)')} AS vec_sum, {s4('vector[1]')} AS vec_first,
           CAST(len(vector) AS INTEGER) AS dims FROM cmean"""))
def a15_catalog_mean_vector(spark, sf_dir):
    cm = R.catalog_mean_vector(Adapters(spark, sf_dir).catalog())
    v = F.col("vector")
    return cm.select(r4(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                     r4(F.element_at(v, 1)).alias("vec_first"), F.size(v).alias("dims"))


# ---------------------------------------------------------------------------------------
# J3 / U3 exclusions, W9 normalised session scores
# ---------------------------------------------------------------------------------------

@register("j3_exclusion_set", with_ctes(_BASE, SQL_SESSION[:3], """
    SELECT session_id, count(*) AS n_excluded FROM excl GROUP BY session_id"""))
def j3_exclusion_set(spark, sf_dir):
    si = SessionInputs(spark, sf_dir)
    return si.excluded.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_excluded"))


@register("j3_exclusion_rows", with_ctes(_BASE, SQL_SESSION[:3], "SELECT session_id, video_id FROM excl"))
def j3_exclusion_rows(spark, sf_dir):
    return SessionInputs(spark, sf_dir).excluded.select("session_id", "video_id")


@register("w9_session_score_norm", with_ctes(["votes"], SQL_SESSION[3:5], f"""
    SELECT session_id, video_id, {s4('session_score')} AS session_score FROM sscore"""))
def w9_session_score_norm(spark, sf_dir):
    si = SessionInputs(spark, sf_dir)
    return si.session_scores.select("session_id", "video_id", r4(F.col("session_score")).alias("session_score"))


# ---------------------------------------------------------------------------------------
# R1 CBF top-30, R4 sequence scores, R7/R8 hybrid cycle
# ---------------------------------------------------------------------------------------

@register("r1_cbf_topn", with_ctes(_BASE, SQL_SESSION + SQL_VECTORS + SQL_CBF, f"""
    SELECT session_id, video_id, genre, rank, {s4('cbf_score')} AS cbf_score,
           {s4('session_score')} AS session_score, {s4('final_score')} AS final_score FROM cbf"""))
def r1_cbf_topn(spark, sf_dir):
    si = SessionInputs(spark, sf_dir, write=True)
    cbf = si.cbf(write=False).join(si.catalog.select("video_id", "genre"), "video_id")
    return cbf.select("session_id", "video_id", "genre", F.col("rank").cast("long").alias("rank"),
                      r4(F.col("cbf_score")).alias("cbf_score"),
                      r4(F.col("session_score")).alias("session_score"),
                      r4(F.col("final_score")).alias("final_score"))


SQL_PRED = [
    ("pred_d", """
        SELECT session_id, i, avg(x) AS m FROM (
          SELECT k.session_id, unnest(k.embedding) AS x, generate_subscripts(k.embedding, 1) AS i
          FROM (SELECT p.session_id, c.embedding,
                       row_number() OVER (PARTITION BY p.session_id ORDER BY p.play_order DESC) AS rb
                FROM plays p JOIN session_state st USING (session_id) JOIN catalog c USING (video_id)
                WHERE st.gru_active) k
          WHERE k.rb <= 15) GROUP BY ALL"""),
    ("pred", "SELECT session_id, list(m ORDER BY i) AS vector FROM pred_d GROUP BY session_id"),
]


@register("r4_sequence_scores_topn", with_ctes(_BASE + ["plays", "session_state"], SQL_PRED + [
    ("gru_all", """
        SELECT p.session_id, c.video_id, list_cosine_similarity(p.vector, c.embedding) AS gru_score
        FROM pred p CROSS JOIN catalog c
        WHERE NOT EXISTS (SELECT 1 FROM played x WHERE x.session_id = p.session_id AND x.video_id = c.video_id)""")],
    f"""
    SELECT session_id, video_id, {s4('gru_score')} AS gru_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY gru_score DESC, video_id) AS rank FROM gru_all)
    WHERE rank <= 30"""))
def r4_sequence_scores_topn(spark, sf_dir):
    si = SessionInputs(spark, sf_dir)
    played = si.played.select("session_id", "video_id", F.lit(True).alias("excluded"), F.lit(0.0).alias("bonus"))
    top = si.songs().top_items(si.predicted(), R.TOP_N, played)
    return top.select("session_id", "video_id", r4(F.col("score")).alias("gru_score"), F.col("rank").cast("long").alias("rank"))


def recommend_cycle(spark, sf_dir) -> DataFrame:
    """R8 for all sessions: vectors -> CBF base set -> CF / sequence on it -> hybrid."""
    si = SessionInputs(spark, sf_dir, write=True)
    cbf = si.cbf()
    idx, pop = si.index()
    cf = R.cf_for_candidates(cbf.select("session_id", "video_id"), si.seeds(), idx, pop,
                             si.played, si.catalog, si.playlist)
    gru = R.pair_cosine(cbf.select("session_id", "video_id"), si.predicted(), si.catalog, "gru_score")
    st = si.a.session_state()
    out = R.hybrid(cbf, cf, gru, st)
    return out.join(si.catalog.select("video_id", "genre"), "video_id")


SQL_HYBRID = [
    ("cf_sess", "SELECT DISTINCT session_id FROM cf"),
    ("fb_vec_d", """
        SELECT session_id, i, avg(x) AS m FROM (
          SELECT s.session_id, unnest(c.embedding) AS x, generate_subscripts(c.embedding, 1) AS i
          FROM (SELECT DISTINCT session_id, seed FROM seeds) s JOIN catalog c ON c.video_id = s.seed) GROUP BY ALL"""),
    ("fb_vec", "SELECT session_id, list(m ORDER BY i) AS vector FROM fb_vec_d GROUP BY session_id"),
    ("base", """
        SELECT b.session_id, b.video_id, b.genre, b.cbf_score, b.session_score,
               CASE WHEN NOT EXISTS (SELECT 1 FROM seeds s WHERE s.session_id = b.session_id) THEN 0.0
                    WHEN b.session_id NOT IN (SELECT session_id FROM cf_sess)
                      THEN (coalesce(list_cosine_similarity(f.vector, c.embedding), 0.0) + 1.0) / 2.0
                    ELSE coalesce(cf.cf_score, 0.0) END AS cf_score,
               list_cosine_similarity(p.vector, c.embedding) AS gru_raw,
               coalesce(st.songs_played, 0) AS songs_played, coalesce(st.gru_active, false) AS gru_active
        FROM cbf b JOIN catalog c ON c.video_id = b.video_id
        LEFT JOIN cf ON cf.session_id = b.session_id AND cf.video_id = b.video_id
        LEFT JOIN fb_vec f ON f.session_id = b.session_id
        LEFT JOIN pred p ON p.session_id = b.session_id
        LEFT JOIN session_state st ON st.session_id = b.session_id"""),
    ("weighted", """
        SELECT *, CAST(CASE WHEN NOT gru_active THEN 0.0 WHEN songs_played = 4 THEN 0.20
                       WHEN songs_played = 5 THEN 0.25 WHEN songs_played = 6 THEN 0.30 ELSE 0.30 END AS DOUBLE)
                  AS gru_weight,
                  gru_active AND EXISTS (SELECT 1 FROM pred q WHERE q.session_id = base.session_id) AS has_gru
        FROM base"""),
    ("final", """
        SELECT session_id, video_id, genre, cbf_score, cf_score, session_score, gru_active, gru_weight, songs_played,
               CASE WHEN has_gru AND gru_weight > 0 THEN coalesce(gru_raw, 0.0) ELSE 0.0 END AS gru_score,
               CASE WHEN has_gru AND gru_weight > 0
                    THEN 0.4::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE + gru_weight) * cbf_score
                         + 0.3::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE + gru_weight) * cf_score
                         + gru_weight / (0.4::DOUBLE + 0.3::DOUBLE + gru_weight) * coalesce(gru_raw, 0.0)
                    ELSE 0.6::DOUBLE * cbf_score + 0.4::DOUBLE * cf_score END + 0.3::DOUBLE * session_score AS final_score
        FROM weighted"""),
]


@register("r8_recommend_cycle", with_ctes(_BASE + ["plays", "session_state"],
                                          SQL_SESSION + SQL_VECTORS + SQL_CBF + SQL_INDEX + SQL_CF
                                          + SQL_PRED + SQL_HYBRID, f"""
    SELECT session_id, video_id, genre, rank, {s4('cbf_score')} AS cbf_score, {s4('cf_score')} AS cf_score,
           {s4('gru_score')} AS gru_score, {s4('session_score')} AS session_score,
           {s4('final_score')} AS final_score, {s4('gru_weight')} AS gru_weight, gru_active
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final_score DESC, video_id) AS rank
          FROM final) WHERE rank <= 30"""))
def r8_recommend_cycle(spark, sf_dir):
    out = recommend_cycle(spark, sf_dir)
    return out.select("session_id", "video_id", "genre", F.col("rank").cast("long").alias("rank"),
                      *[r4(F.col(c)).alias(c) for c in
                        ("cbf_score", "cf_score", "gru_score", "session_score", "final_score", "gru_weight")],
                      "gru_active")


@register("s18_recommendation_snapshots", with_ctes(_BASE + ["plays", "session_state"],
                                                    SQL_SESSION + SQL_VECTORS + SQL_CBF + SQL_INDEX + SQL_CF + SQL_PRED + SQL_HYBRID + [
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final_score DESC, video_id) AS rank FROM final"),
    ("w", """SELECT session_id, any_value(gru_active) AS a, any_value(gru_weight) AS g FROM ranked GROUP BY 1""")], f"""
    SELECT r.session_id, CASE WHEN NOT a THEN 'cold_start' WHEN g = 0.2 THEN 'gru_soft_entry' WHEN g = 0.25 THEN 'gru_growing' ELSE 'full_hybrid' END AS phase,
           CASE WHEN NOT a OR g = 0 THEN 0.6 ELSE {s4('0.4 / (0.7 + g)')} END::DOUBLE AS weight_cbf,
           CASE WHEN NOT a OR g = 0 THEN 0.4 ELSE {s4('0.3 / (0.7 + g)')} END::DOUBLE AS weight_cf,
           CASE WHEN NOT a OR g = 0 THEN 0.0 ELSE {s4('g / (0.7 + g)')} END::DOUBLE AS weight_gru,
           string_agg(rank || ':' || video_id || ':' || genre, ' ' ORDER BY rank) AS songs, {s4('sum(round(final_score, 4))')} AS score_sum
    FROM ranked r JOIN w USING (session_id) WHERE rank <= 30 GROUP BY r.session_id, a, g"""))
def s18_recommendation_snapshots(spark, sf_dir):
    """The cycle's lists replace the sessions' lists, their snapshots are appended; read back."""
    out = materialise(recommend_cycle(spark, sf_dir), "recommendations")
    path = scratch(spark, "snapshots")
    sinks.replace_lists(out, f"{path}/lists")
    sinks.append_events(recommendation_snapshots(out), f"{path}/recommendations")
    snap = spark.read.parquet(f"{path}/recommendations")
    songs = F.array_join(F.transform("songs", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["video_id"], x["genre"])), " ")
    return snap.select("session_id", "phase", *[F.col(f"weights.{w}").alias(f"weight_{w}") for w in ("cbf", "cf", "gru")], songs.alias("songs"),
                       r4(F.aggregate("songs", F.lit(0.0), lambda a, x: a + x["final_score"])).alias("score_sum"))
