"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a file is named by the SHA-256 of its text.  The ledger holds
(blob, rule version) pairs already scanned with what was found; only unseen
pairs are scanned, each once, however many paths and versions hold the blob.
Findings are then joined back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

RULE_VERSION = 1
#: Base rules (fixed values).  Only the first has a length rule on its value: 6 characters.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"  # of AKIA[A-Z0-9]+ the matches of 20 and more; shorter ones end where these cannot start
HEX = "[0-9a-f]{24,}"  # likewise of [0-9a-f]+
#: Rules that the method adds: key blocks and tokens with a prefix of their own (fixed values).  A token's head is
#: bounded, as each ``eyJ`` of a long run would be followed to the run's end otherwise.
ADDED = {
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github": "gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": "eyJ[A-Za-z0-9_-]{10,1000}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}",
}
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = [*BASE, *ADDED]


def _numbered(place: int, least: int):
    """Of (length before, length, length of the value) and a number; a value is valid from ``least`` characters."""
    return lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), x["p"].alias("p"), x["m"].alias("m"), (x["v"] >= least).alias("ok"))


def _lengths(rules: dict[str, str]) -> Column:
    """One array of (place of kind, number, length before, length, valid) of all matches, from the pieces between matches.

    A regular expression's matches and the text split by it alternate, so
    starts are running sums of lengths (in code points).  Texts without a match
    are not split.
    """
    text, arrays = F.col("text"), []
    for place, (k, p) in enumerate(rules.items()):
        matches = F.transform(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)), lambda m: F.length(m))
        pieces = F.transform(F.split(text, p, -1), lambda x: F.length(x))
        values = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x)) if k == "assign" else matches
        zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"), values.alias("v"))
        found = F.filter(F.transform(zipped, _numbered(place, 6 if k == "assign" else 0)), lambda x: x["m"].isNotNull())  # the last piece is after all matches
        arrays.append(F.when(F.rlike(text, F.lit(p)), found).otherwise(F.array().cast("array<struct<place:int,i:int,p:int,m:int,ok:boolean>>")))
    return F.concat(*arrays)


def _spans(found: DataFrame) -> DataFrame:
    """(blob_id, counts, base_spans, spans) of the blobs with matches, by (blob_id, found).

    Matches are rows here, so a running sum is a window over one blob's matches
    of a kind and a text of very many matches costs no more for each of them.
    """
    each = found.select("blob_id", F.inline("found")).repartition("blob_id")
    upto = Window.partitionBy("blob_id", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("p") + F.col("m")).over(upto).cast("int")).filter("ok")
    spans = ends.groupBy("blob_id").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("m")).alias("start"), "place", "end"))).alias("all"),
        *[F.count_if(F.col("place") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["place"] < len(BASE))
    return spans.select("blob_id", *[f"n_{k}" for k in KINDS], joined(base).alias("base_spans"), joined(F.col("all")).alias("spans"))


def scan(blobs: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows of (blob_id, text), one for each blob: counts of kinds, base spans and all spans as text.

    Lengths of matches are written once, without the texts.
    """
    found = materialize(blobs.select("blob_id", _lengths(BASE | ADDED).alias("found")).dropDuplicates(["blob_id"]), "scanned")
    ledger = found.select("blob_id").join(_spans(found.filter(F.size("found") > 0)), "blob_id", "left")
    return ledger.select(
        "blob_id",
        F.lit(rule_version).alias("rule_version"),
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")],
    )


def with_blob(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob_id, text); a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def update_ledger(versions: DataFrame, ledger_dir: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scans the blobs of ``versions`` (path, blob_id, text) that the ledger lacks under this rule
    version; returns one ledger row for each of its blobs, also where two writers scanned one at once.

    With ``ledger_dir`` the ledger is a Parquet folder that grows by one write per
    call; without, it is empty and lives for this call.  One path per blob is
    elected by aggregation over names, so texts move once, by path, and a blob
    with very many copies is no hot key.
    """
    spark = versions.sparkSession
    names = versions.select("blob_id", F.coalesce(F.col("path").cast("string"), F.concat(F.lit("?"), "blob_id")).alias("at"))
    elected = names.groupBy("blob_id").agg(F.min("at").alias("at"))
    known = None
    if ledger_dir and _exists(spark, ledger_dir):
        known = spark.read.parquet(ledger_dir).filter(F.col("rule_version") == rule_version)
        elected = elected.join(known.select("blob_id"), "blob_id", "left_anti")
    own = versions.withColumn("at", F.coalesce(F.col("path").cast("string"), F.concat(F.lit("?"), "blob_id")))
    chosen = elected.select(F.col("at").alias("_at"), F.col("blob_id").alias("_blob")).hint("shuffle_hash")
    unseen = own.join(chosen, (F.col("at") == F.col("_at")) & (F.col("blob_id") == F.col("_blob")), "left_semi")
    fresh = scan(unseen.select("blob_id", "text"), rule_version)
    if ledger_dir is None:
        return materialize(fresh, "ledger")
    fresh.write.mode("append").parquet(ledger_dir)
    ledger = spark.read.parquet(ledger_dir).filter(F.col("rule_version") == rule_version)
    return ledger.join(names.select("blob_id").distinct(), "blob_id", "left_semi").dropDuplicates(["blob_id"])


def find_secrets(docs: DataFrame, ledger_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob_id, n_<kind>..., base_spans, spans) of every row.

    Null and empty texts have no spans; null ids are kept; repeated rows repeat
    their findings; an empty table gives an empty result.
    """
    versions = with_blob(docs, id_col, text_col)
    ledger = update_ledger(versions, ledger_dir)
    counts = [f"n_{k}" for k in KINDS]
    found = ledger.filter("spans <> ''").select("blob_id", *counts, "base_spans", "spans")
    paths = versions.select(F.col("path").alias(id_col), "blob_id")
    out = paths.join(found, "blob_id", "left")
    return out.select(
        id_col,
        "blob_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")],
    )


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = find_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    rules = BASE | ADDED
    quoted = {k: p.replace("'", "''") for k, p in rules.items()}
    parts = []
    for place, (k, p) in enumerate(quoted.items()):
        value = f"list_transform(regexp_extract_all(t, '{p}', 2), lambda x: length(x))" if k == "assign" else "NULL::BIGINT[]"
        parts.append(
            f"""SELECT doc_id, '{k}' AS kind, {place} AS place, regexp_extract_all(t, '{p}') AS m,
            regexp_split_to_array(t, '{p}') AS p, {value} AS v FROM docs WHERE regexp_matches(t, '{p}')"""
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    line = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    raw AS ({" UNION ALL ".join(parts)}),
    rows AS (SELECT doc_id, kind, place, UNNEST(range(1, len(m) + 1)) AS i, m, p, v FROM raw),
    spans AS (SELECT doc_id, kind, place, length(m[i]) AS n,
      (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM rows WHERE v IS NULL OR v[i] >= 6),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
      {line} FILTER (kind IN ({base})) AS base, {line} AS every FROM spans GROUP BY 1)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM docs LEFT JOIN per USING (doc_id)"""


ORACLE = _oracle()
