"""Scalar column functions. Each is ``Column -> Column`` and JVM-side.

Python-vs-JVM text rules (D6): Python ``\\s`` and ``str.strip`` are Unicode-aware, so the
patterns below use ``(?U)`` and add U+001C-U+001F, which Python also counts as whitespace;
``(?d)`` makes ``.`` stop only at ``\\n`` as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's -----------------------------------
FEEDBACK_WEIGHTS = {"like": 2.0, "dislike": -2.0, "skip": -0.5, "replay": 1.5}
ACTION_TO_PREF = {"like": "liked", "dislike": "disliked", "skip": "skipped", "replay": "replayed"}
PLAY_FEEDBACK = {"like": "like", "dislike": "dislike", "skip": "skip", "replay": "replay"}
ENGAGEMENT_WORDING = [
    (0.5, "Excellent — group is highly engaged"),
    (0.2, "Good — recommendations landing well"),
    (-0.1, "Neutral — room for improvement"),
    (-0.4, "Below average — consider bias checks"),
]
ENGAGEMENT_WORDING_LOWEST = "Poor — review recommendation weights"
TITLE_NOISE_PATTERN = r"[\(\[\|].*?[\)\]\|]"
POPULARITY_WEIGHTS = (0.5, 0.3, 0.2)  # views, likes, comments
# --------------------------------------------------------------------------------------

_PY_SPACE = r"\s\x{1c}-\x{1f}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends. Texts that begin and end with a visible
    ASCII character have none; the Unicode pattern is tried at every character, so they skip it."""
    c = col(c)
    visible = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(visible, c).otherwise(F.regexp_replace(c, rf"(?U)^[{_PY_SPACE}]+|[{_PY_SPACE}]+$", ""))


# What Python's float() and int() take (after stripping); Java's parser also takes "12d" or "1f".
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT = rf"^[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
PY_FLOAT_WORD = r"(?i)^[+-]?(?:inf|infinity|nan)$"
PY_INT = rf"^[+-]?{_DIGITS}$"
# The common spelling, which Python and Java read alike; everything else takes the patterns above.
PLAIN_INT = r"^-?[0-9]{1,18}\z"
PLAIN_NUMBER = r"^-?[0-9]{1,18}(?:\.[0-9]{1,18})?\z"
MAX_LONG = float(2 ** 63)


def py_float(c) -> Column:
    """Python ``float(text)`` as double (infinities and NaN included); null where it raises."""
    text = col(c).cast("string")
    t = py_strip(text)
    other = F.when(t.rlike(PY_FLOAT) | t.rlike(PY_FLOAT_WORD), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")).otherwise(other)


# P1 / D5 ---------------------------------------------------------------------------------
def lenient_millis(c, number: Column | None = None) -> Column:
    """Null / '' -> 0; int(float(x)) truncating; unparsable or NaN -> 0. Values with no
    64-bit integer are null, see ``millis_error``. ``number``: ``py_float(c)``, where it is at hand."""
    c = col(c)
    d = py_float(c) if number is None else number
    return (F.when(c.isNull() | (c.cast("string") == ""), F.lit(0).cast("long"))
            .when(d.isNull() | F.isnan(d), F.lit(0).cast("long"))
            .when(F.abs(d) >= MAX_LONG, F.lit(None).cast("long"))
            .otherwise(d.try_cast("long")))


def millis_error(c, number: Column | None = None) -> Column:
    """Error text for values whose float is infinite, or has no 64-bit integer (Python keeps
    those as big integers; a long column cannot, so the row is rejected); null otherwise."""
    d = py_float(c) if number is None else number
    return (F.when(F.abs(d) == float("inf"), F.lit("cannot convert float infinity to integer"))
            .when(F.abs(d) >= MAX_LONG, F.lit("integer out of 64-bit range")))


# P2
def seconds_from_millis(millis) -> Column:
    """Floor division by 1000 (Python ``//``; negative values round down)."""
    return F.floor(col(millis) / F.lit(1000)).cast("long")


# P3
def lenient_int(c) -> Column:
    """Python ``int(x)`` on text: '3.7' -> 0, '1_000' -> 1000, bad or null -> 0 (and 0 for
    integers beyond 64 bits)."""
    text = col(c).cast("string")
    t = py_strip(text)
    n = F.when(t.rlike(PY_INT), F.replace(t, F.lit("_"), F.lit("")).try_cast("long"))
    return F.when(text.rlike(PLAIN_INT), text.try_cast("long")).otherwise(F.coalesce(n, F.lit(0).cast("long")))


# P4
def safe_ratio(num, den) -> Column:
    """Num / den, 0.0 when den is 0 (or null)."""
    return F.when(F.coalesce(col(den), F.lit(0)) != 0,
                  col(num).cast("double") / col(den).cast("double")).otherwise(F.lit(0.0))


# P5
def clean_search_title(c) -> Column:
    """P5: drop each shortest span from '(', '[' or '|' to ')', ']' or '|', then strip."""
    return py_strip(F.regexp_replace(col(c), "(?d)" + TITLE_NOISE_PATTERN, ""))


# P6
def clean_text(c) -> Column:
    """Null -> 'unknown'; lower; keep a-z, 0-9 and whitespace; strip."""
    t = F.lower(col(c))
    # in ASCII texts both patterns match the same characters; the Unicode one is the slower by far
    kept = F.when(F.octet_length(t) == F.length(t), F.regexp_replace(t, rf"[^a-z0-9{_PY_SPACE}]", "")).otherwise(
        F.regexp_replace(t, rf"(?U)[^a-z0-9{_PY_SPACE}]", ""))
    return F.when(col(c).isNull(), F.lit("unknown")).otherwise(py_strip(kept))


# P7
def fill_unknown(c, literal: str = "unknown") -> Column:
    """Categorical null -> literal (D1: 'unknown' at ML level, 'Unknown' at data level)."""
    return F.coalesce(col(c), F.lit(literal))


# P8
def numeric_or_zero(c) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(0)``."""
    d = col(c).cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)


# P9
def duration_seconds(millis) -> Column:
    return col(millis).cast("double") / F.lit(1000.0)


# P10 / D7
def recomputed_ratio(stored, num, den) -> Column:
    """P10: when the stored ratio is 0, num / den with den 0 -> 1."""
    den_safe = F.when(col(den) == 0, F.lit(1.0)).otherwise(col(den).cast("double"))
    return F.when(col(stored) == 0, col(num).cast("double") / den_safe).otherwise(col(stored).cast("double"))


# P11 (window per dataset key; constant column -> 0)
def min_max(c, window) -> Column:
    lo, hi = F.min(col(c)).over(window), F.max(col(c)).over(window)
    return F.when(hi == lo, F.lit(0.0)).otherwise((col(c) - lo) / (hi - lo))


# P12
def song_sentence(title, artist, genre, album) -> Column:
    """P12: 'title: … artist: … genre: … album: …' (missing values render as pandas 'nan')."""
    def s(x):
        return F.coalesce(col(x).cast("string"), F.lit("nan"))
    return F.format_string("title: %s artist: %s genre: %s album: %s", s(title), s(artist), s(genre), s(album))


# P15 / D8
def feedback_weight(action, weights: dict | None = None) -> Column:
    """Like +2, dislike -2, skip -0.5, replay +1.5, otherwise 0; case-insensitive."""
    w = weights or FEEDBACK_WEIGHTS
    m = F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(m[F.lower(col(action))], F.lit(0.0))


# P16
def action_preference(action) -> Column:
    """Action -> preference list name, null for other actions."""
    m = F.create_map(*[F.lit(x) for kv in ACTION_TO_PREF.items() for x in kv])
    return m[col(action)]


# P17
def event_timestamp(c) -> Column:
    """ISO text / timestamp -> timestamp; missing or unparsable -> now."""
    return F.coalesce(F.try_to_timestamp(col(c).cast("string")), F.current_timestamp())


# P18
def room_to_session(c) -> Column:
    """Strip a leading 'AUX-' (any case), lower-case."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?i)^AUX-", ""))


# P19
def play_feedback(action) -> Column:
    """Like / dislike / skip / replay pass through, anything else -> 'neutral'."""
    m = F.create_map(*[F.lit(x) for kv in PLAY_FEEDBACK.items() for x in kv])
    return F.coalesce(m[col(action)], F.lit("neutral"))


# P23
def scored_song(rank, video_id, title, artist, genre, cbf, cf, gru, final) -> Column:
    """Monitoring struct with scores rounded to 4 dp."""
    def r(x):
        return F.round(F.coalesce(col(x), F.lit(0.0)), 4)
    return F.struct(col(video_id).cast("string").alias("video_id"),
                    F.coalesce(col(title).cast("string"), F.lit("")).alias("title"),
                    F.coalesce(col(artist).cast("string"), F.lit("")).alias("artist"),
                    F.coalesce(col(genre).cast("string"), F.lit("")).alias("genre"),
                    r(cbf).alias("cbf_score"), r(cf).alias("cf_score"), r(gru).alias("gru_score"),
                    r(final).alias("final_score"), col(rank).alias("rank"))


# P24
def engagement_wording(score) -> Column:
    out = F.lit(ENGAGEMENT_WORDING_LOWEST)
    for cut, text in reversed(ENGAGEMENT_WORDING):
        out = F.when(col(score) >= cut, F.lit(text)).otherwise(out)
    return out


# P25
def bias_health(flags) -> Column:
    """P25: 0 flags ok, 1 warn, 2+ critical."""
    n = F.size(F.coalesce(col(flags), F.array().cast("array<string>")))
    return F.when(n == 0, "ok").when(n == 1, "warn").otherwise("critical")


# P26 (JS falsy chains: '', 0 and null fall through)
def js_or(*cols, default=None) -> Column:
    """``a || b || … || default`` with JavaScript falsiness by type: '' of strings (the text '0'
    is true), 0 and NaN of numbers, false of booleans."""
    parts = []
    for c in cols:
        c = col(c)
        text, number = c.cast("string"), c.cast("string").try_cast("double")
        falsy = F.when(F.typeof(c) == "string", text == "").otherwise(
            (text == "false") | F.coalesce((number == 0) | F.isnan(number), F.lit(False)))
        parts.append(F.when(falsy, F.lit(None)).otherwise(c))
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def round_to(x, digits: int = 4) -> Column:
    """Round half away from zero on the binary value: round(x·10^d) / 10^d, the arithmetic the
    SQL engines use (Spark's ``round`` rounds the shortest decimal text instead, so
    3/20000 would give 0.0002 here but 0.0001 there). ``+ 0.0`` folds -0.0 into 0.0."""
    x = col(x).cast("double")
    s = float(10 ** digits)
    q = x * F.lit(s)
    r = F.when(q >= 0, F.floor(q + F.lit(0.5))).otherwise(-F.floor(-q + F.lit(0.5)))
    return r.cast("double") / F.lit(s) + F.lit(0.0)


def format_pct1(x) -> Column:
    """'%.1f' as Python formats it (half-even on ties), for report messages."""
    return F.format_string("%.1f", F.bround(col(x).cast("double"), 1))
