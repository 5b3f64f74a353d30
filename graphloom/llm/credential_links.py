"""Secret scans with multipart credential linking. DataFrame functions only.

Strong candidates (a secret assigned to a telling name, a cloud access key, a long hex string) are reported alone. Weak
ones (a login, a token that only looks random, an endpoint) are parts: each is reported only if a complementary part lies
in its scope, the SCOPE characters before and after it, without overlapping it. Which parts' scopes meet is found by an
interval join in as-of form: ordered by place, a part needs only the nearest part of each role before and after it, so no
pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 300


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Fixed value: names that announce a secret, and the secret itself as the only group.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Name, role, pattern, and what a match must also satisfy (SQL over m, the match), in order of kind.
# Base kinds match first and drop failing matches afterwards.
KINDS = [
    ("assign", "secret", ASSIGN, f"length(regexp_extract(m, {_sql(ASSIGN)}, 1)) >= 12"),
    ("access", "id", r"AKIA[A-Z0-9]+", "length(m) >= 18"),
    ("hex", "secret", r"[0-9a-f]{16,}", "true"),
    ("login", "id", r"""(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+""", "true"),
    ("token", "secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])", "m RLIKE '[0-9]' AND m RLIKE '[a-z]' AND m RLIKE '[A-Z]'"),
    ("endpoint", "place", r"""(?i)(?<![A-Za-z0-9])(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", "true"),
]
BASE = 3


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Places count code points, ends are exclusive. spans lists kind:start:end by start, then kind. A match and the text
    before it alternate, so their lengths, summed up, give all places. Null and empty texts hold nothing (base_sha256 is
    then of the empty string). Rows are told apart by a number of their own: repeated rows and null ids are reported
    each. Other columns are ignored; an empty table gives no rows. Texts are scanned whole; time grows with a text's length
    and its number of candidates (as their sort does), not with their square.
    """
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for k, (_, _, pattern, check) in enumerate(KINDS):
        p = _sql(pattern)
        check = check.replace("\n", " ")
        gaps = f"transform(split(text, {p}, -1), x -> length(x))"
        hits = f"transform(regexp_extract_all(text, {p}, 0), m -> struct(length(m) AS len, {check} AS ok))"
        each = f"transform(zip_with({hits}, {gaps}, (h, g) -> struct(h, g)), (z, i) -> struct({k} AS kind, i AS n, z.g AS gap, z.h.len AS len, z.h.ok AS ok))"
        # split gives one part more than there are matches; the last one is dropped with its missing match
        found.append(f"CASE WHEN text RLIKE {p} THEN filter({each}, z -> z.len IS NOT NULL) ELSE cast(array() AS array<struct<kind:int,n:int,gap:int,len:int,ok:boolean>>) END")
    df = df.select("row", "doc_id", F.explode_outer(F.expr(f"concat({', '.join(found)})")).alias("z")).select("row", "doc_id", "z.*")
    upto = Window.partitionBy("row", "kind").orderBy("n")
    df = df.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    df = df.withColumn("ok", F.coalesce("ok", F.lit(False)))
    role = F.lit(None)
    for k, (_, r, _, _) in enumerate(KINDS):
        role = F.when(F.col("kind") == k, F.lit(r)).otherwise(role)
    df = df.withColumn("role", F.when(F.col("ok"), role))
    # each part as its two ends in order of place, an end before a start at the same place: the last end of a role before
    # a part's start, and the first start after its end, are of the nearest parts that don't overlap it
    ends = F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("opens")), F.struct(F.col("start").alias("at"), F.lit(1).alias("opens")))
    points = df.withColumn("point", F.explode(ends)).select("row", "doc_id", "kind", "n", "start", "end", "ok", "role", "point.*")
    # both frames grow from their partition's start, so Spark carries one value along; a frame up to the end it would
    # read again for every row
    ahead = Window.partitionBy("row").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)
    meets = {}
    for r in ("id", "secret", "place"):
        last, first = F.max(F.when((F.col("role") == r) & (F.col("opens") == 0), F.col("at"))).over(ahead), F.min(F.when((F.col("role") == r) & (F.col("opens") == 1), F.col("at"))).over(back)
        meets[f"near_{r}"] = F.coalesce(F.when(F.col("opens") == 1, F.col("at") - last <= SCOPE).otherwise(first - F.col("at") <= SCOPE), F.lit(False))
    df = points.withColumns(meets).groupBy("row", "doc_id", "kind", "n", "start", "end", "ok", "role").agg(*[F.max(c).alias(c) for c in meets])
    # an endpoint and a login without any secret are no credential
    df = df.withColumn("linked", F.when(F.col("role") == "secret", F.col("near_id") | F.col("near_place")).otherwise(F.col("near_secret")))
    shown = F.col("ok") & ((F.col("kind") < BASE) | F.coalesce("linked", F.lit(False)))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"))
    count = lambda k: F.count(F.when(F.col("ok") & (F.col("kind") == k), 1))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, span))), lambda x: x["said"]), ",")
    out = df.groupBy("row", "doc_id").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), listed(F.col("ok") & (F.col("kind") < BASE)).alias("base"), listed(shown).alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
