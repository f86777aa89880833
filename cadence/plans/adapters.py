"""Adapters: the reference's entities as projections of the driver tables.

Each adapter exists twice with identical meaning: a DataFrame builder (used by the Spark
queries) and a SQL common-table expression (used by the DuckDB oracle). All of them read the
whole tables; nothing is sampled or capped, so the work grows with the data.

Entity mapping
  catalog        embeddings: video_id = vec_id, genre = 'genre_' || label, embedding as double[]
  likes          orders ⋈ lineitem: user = o_custkey (as text), song = l_partkey mod |catalog|
  dislikes       the same where l_returnflag = 'R'
  sessions       four consecutive orders form one listening session: session_id = o_orderkey div 4
  members        distinct (session, o_custkey) of those orders
  plays          lineitems of the session's orders, play_order by (order, line), liked = flag 'N'
  playlist       the session's liked plays (the songs the group brought; pseudo-user, D32)
  votes          queue feedback: song = l_suppkey mod |catalog|, action from l_returnflag
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.numbering import numbered
from cadence.sources.tables import Tables

SESSION_SIZE = 4  # orders per listening session


class Adapters:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)
        self.spark = spark

    # -- catalog -------------------------------------------------------------------
    def catalog_size(self):
        """Scalar-subquery column holding |catalog|; no driver round trip."""
        return self.t.embeddings.select(F.count(F.lit(1))).scalar()

    def song(self, key_col: str):
        return F.pmod(F.col(key_col), self.catalog_size())

    def catalog(self) -> DataFrame:
        part = self.t.part.select(F.col("p_partkey").alias("video_id"), "p_size")
        return (self.t.embeddings
                .select(F.col("vec_id").alias("video_id"),
                        F.concat(F.lit("genre_"), F.col("label").cast("string")).alias("genre"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
                .join(part, "video_id", "left")
                .select("video_id", "genre", "embedding",
                        F.coalesce(F.col("p_size") / F.lit(50.0), F.lit(0.0)).alias("popularity_score")))

    # -- population ----------------------------------------------------------------
    def _order_lines(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey")
        l = self.t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
        return o.join(l, "o_orderkey")

    def likes(self) -> DataFrame:
        return (self._order_lines()
                .select(F.col("o_custkey").cast("string").alias("user_id"),
                        self.song("l_partkey").alias("video_id")).distinct())

    def dislikes(self) -> DataFrame:
        return (self._order_lines().where(F.col("l_returnflag") == "R")
                .select(F.col("o_custkey").cast("string").alias("user_id"),
                        self.song("l_partkey").alias("video_id")).distinct())

    # -- sessions ------------------------------------------------------------------
    @staticmethod
    def _session(col: str):
        return F.expr(f"{col} div {SESSION_SIZE}")

    def members(self) -> DataFrame:
        return (self.t.orders
                .select(self._session("o_orderkey").alias("session_id"),
                        F.col("o_custkey").cast("string").alias("user_id")).distinct())

    def plays(self) -> DataFrame:
        """Numbered by ranges, so that no session is sorted in one task; written once."""
        rows = self.t.lineitem.select(
            self._session("l_orderkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
            self.song("l_partkey").alias("video_id"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("liked_flag"))
        out = numbered(rows, "session_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])
        return out.drop("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")

    def played(self) -> DataFrame:
        return (self.t.lineitem.select(self._session("l_orderkey").alias("session_id"), self.song("l_partkey").alias("video_id")).distinct())

    def playlist(self) -> DataFrame:
        return (self.t.lineitem.where(F.col("l_returnflag") == "N")
                .select(self._session("l_orderkey").alias("session_id"),
                        self.song("l_partkey").alias("video_id")).distinct())

    def session_state(self) -> DataFrame:
        """(session_id, songs_played, gru_active): active at >= 3 plays (a model is supplied)."""
        return (self.t.lineitem.groupBy(self._session("l_orderkey").alias("session_id"))
                .agg(F.count(F.lit(1)).cast("int").alias("songs_played"))
                .withColumn("gru_active", F.col("songs_played") >= 3))

    def votes(self) -> DataFrame:
        """Queue feedback events: (session_id, video_id, action)."""
        return (self.t.lineitem
                .select(self._session("l_orderkey").alias("session_id"),
                        self.song("l_suppkey").alias("video_id"),
                        F.when(F.col("l_returnflag") == "N", "like")
                        .when(F.col("l_returnflag") == "R", "dislike")
                        .otherwise("skip").alias("action")))


# ----------------------------------------------------------------------------------------
# The same adapters as DuckDB common-table expressions (oracle side).
# ----------------------------------------------------------------------------------------

SQL_ADAPTERS = {
    "ncat": "SELECT count(*) AS n FROM embeddings",
    "catalog": """
        SELECT e.vec_id AS video_id, 'genre_' || CAST(e.label AS VARCHAR) AS genre,
               CAST(e.embedding AS DOUBLE[]) AS embedding,
               coalesce(p.p_size / 50.0, 0.0) AS popularity_score
        FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id""",
    "likes": """
        SELECT DISTINCT CAST(o.o_custkey AS VARCHAR) AS user_id, l.l_partkey % (SELECT n FROM ncat) AS video_id
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    "dislikes": """
        SELECT DISTINCT CAST(o.o_custkey AS VARCHAR) AS user_id, l.l_partkey % (SELECT n FROM ncat) AS video_id
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'""",
    "members": """
        SELECT DISTINCT o_orderkey // 4 AS session_id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders""",
    "plays": """
        SELECT l_orderkey // 4 AS session_id, l_partkey % (SELECT n FROM ncat) AS video_id,
               CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS liked_flag,
               row_number() OVER (PARTITION BY l_orderkey // 4
                                  ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS play_order
        FROM lineitem""",
    "played": "SELECT DISTINCT session_id, video_id FROM plays",
    "playlist": """
        SELECT DISTINCT l_orderkey // 4 AS session_id, l_partkey % (SELECT n FROM ncat) AS video_id
        FROM lineitem WHERE l_returnflag = 'N'""",
    "session_state": """
        SELECT l_orderkey // 4 AS session_id, CAST(count(*) AS INTEGER) AS songs_played,
               count(*) >= 3 AS gru_active
        FROM lineitem GROUP BY 1""",
    "votes": """
        SELECT l_orderkey // 4 AS session_id, l_suppkey % (SELECT n FROM ncat) AS video_id,
               CASE WHEN l_returnflag = 'N' THEN 'like' WHEN l_returnflag = 'R' THEN 'dislike'
                    ELSE 'skip' END AS action
        FROM lineitem""",
}

# dependencies between CTEs, so a query can ask for only what it uses
_SQL_DEPS = {
    "catalog": [], "ncat": [], "likes": ["ncat"], "dislikes": ["ncat"], "members": [],
    "plays": ["ncat"], "played": ["plays"], "playlist": ["ncat"], "session_state": [],
    "votes": ["ncat"],
}


def with_ctes(names: list[str], extra: list[tuple[str, str]], final: str) -> str:
    """Compose ``WITH`` adapters (in dependency order) + extra CTEs + final SELECT."""
    order: list[str] = []

    def add(n):
        for d in _SQL_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL_ADAPTERS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra]
    if not parts:
        return final
    return "WITH " + ",\n".join(parts) + "\n" + final
