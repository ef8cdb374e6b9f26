"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

The ranks of one-line prefixes are the line ids.  A round pairs each place's
rank with the rank ``h`` lines on, so ranks of h-line prefixes become ranks of
2h-line prefixes, in lexicographic order of line ids.  A place whose prefix is
unique has its final rank and leaves: only repeated prefixes go on, and rounds
end when no rank repeats.

Places whose common prefix is a run of the least length (``run`` lines, or fewer
lines of ``words`` words together) are an interval of the array.  Every place of
an interval but the first one (by id, then line) starts a later copy.  Its
common prefix with the first place is read off the ranks of the rounds, the
longest first: where the ranks of 2^j lines agree, both move on by 2^j.  Starts
that no equal line precedes on both sides give the maximal repeated runs, each
with its source and length, and the lines of later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release, scratch
from .keyed import LAST, doc_id, keyed, once
from .shared import aside, lean, sliced

#: The least run: so many lines, or fewer of so many words.
RUN, WORDS = 3, 50
_SPACE = " \t\n\x0b\x0c\r"


def line_ids(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(k, c, p, r, w1, w2...): the lines that have a word, numbered from 0, with a 64-bit id of their text.

    ``w<d>`` is the number of words of the d lines from here on, for d < ``run``;
    null if the text has fewer.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, words = [], [], []
            for i, text in enumerate(batch.column(2)):
                for line in text.as_py().encode("utf-8", "surrogatepass").split(b"\n"):
                    if n := len(line.split()):
                        at.append(i)
                        ids.append(xxhash.xxh3_64_intdigest(line))
                        words.append(n)
            at, words = np.array(at, np.int32), np.array(words, np.int64)
            upto, place = np.concatenate(([0], np.cumsum(words))), np.arange(len(at))
            first = np.searchsorted(at, at, "left")
            end = np.searchsorted(at, at, "right")
            own = pa.array(at)
            out = {"k": batch.column(0).take(own), "c": batch.column(1).take(own), "p": pa.array((place - first).astype(np.int32))}
            out["r"] = pa.array(np.array(ids, np.uint64).view(np.int64))
            for d in range(1, run):
                out[f"w{d}"] = pa.array((upto[np.minimum(place + d, len(at))] - upto[place]).astype(np.int32), mask=place + d > end)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    sums = "".join(f", w{d} int" for d in range(1, run))
    return rows.select("k", "c", "text").mapInArrow(lean(name), f"k {dict(rows.dtypes)['k']}, c long, p int, r long{sums}")


def _repeated(state: DataFrame, *names: str) -> DataFrame:
    """The ranks that more than one place has."""
    return state.groupBy(*[F.col(n).alias(f"_{n}") for n in names]).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def _ahead(state: DataFrame, lines: int) -> DataFrame:
    """Adds b: the rank so many lines on in the same text; places without one go."""
    at = Window.partitionBy("k", "c").orderBy("p").rangeBetween(lines, lines)
    return state.withColumn("b", F.max("r").over(at)).filter("b IS NOT NULL")


def rank_rounds(ids: DataFrame, run: int) -> list[DataFrame]:
    """Written (k, c, p, r, w...) for prefixes of 1, 2, 4... lines: the places whose prefix is repeated."""
    twice = materialize(_repeated(ids, "r"), "repeated")
    rounds = [materialize(ids.join(twice, ids["r"] == twice["_r"], "left_semi"), "ranks")]
    release(twice)
    while not rounds[-1].isEmpty():
        h = 1 << len(rounds) - 1
        state = rounds[-1] if h < run else rounds[-1].select("k", "c", "p", "r")
        pairs = materialize(_ahead(state, h).withColumnRenamed("r", "a"), "pairs")
        # ranks rise with (a, b) but have gaps; they are written, so a rank that very many places share can be split in the join
        ranks = _repeated(pairs, "a", "b").orderBy("_a", "_b").withColumn("_rank", F.monotonically_increasing_id())
        ranks = materialize(ranks, "numbered")
        ranked = pairs.join(ranks, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
        rounds.append(materialize(ranked.select("k", "c", "p", F.col("_rank").alias("r"), *state.columns[4:]), "ranks"))
        release(pairs, ranks)
    return rounds[:-1]


def _later(state: DataFrame, *names: str) -> DataFrame:
    """(k, c, p, f): places of ``state`` after the first one, f, of their interval."""
    first = state.groupBy(*[F.col(n).alias(f"_{n}") for n in names]).agg(F.min(F.struct("k", "p", "c")).alias("f"))
    first = materialize(first, "first")
    same = [state[n] == first[f"_{n}"] for n in names]
    joined = state.join(first, same)
    return joined.filter((F.col("k") > F.col("f.k")) | (F.col("p") > F.col("f.p"))).select("k", "c", "p", "f")


def maximal_runs(rows: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(k, c, p, n, source_k, source_p): the maximal repeated runs of later copies; written.

    ``n`` lines from line p on equal those from line ``source_p`` of ``source_k``
    on, which is the first place of the least run that starts at p; neither the
    lines before nor those behind are equal (or the latter have another first
    place).  Order is (k, p).
    """
    with scratch() as keep:
        ids = materialize(line_ids(once(rows), run), "lines")
        rounds = rank_rounds(ids, run)
        release(ids)
        starts = None
        for d in range(1, run + 1):
            j = d.bit_length() - 1
            if j >= len(rounds):
                break
            state, names = rounds[j], ["r"]
            if d < run:
                if words is None:
                    continue
                state = state.filter(F.col(f"w{d}") >= words)
            if d > 1 << j:  # a prefix of d lines is two overlapping ones of 2^j
                state, names = _ahead(rounds[j], d - (1 << j)), ["r", "b"]
                if d < run:
                    state = state.filter(F.col(f"w{d}") >= words)
            later = _later(state, *names)
            starts = later if starts is None else starts.unionByName(later)
        kinds = dict(rows.dtypes)
        if starts is None:
            empty = f"k {kinds['k']}, c long, p int, n int, source_k {kinds['k']}, source_p int"
            return keep(materialize(rows.sparkSession.createDataFrame([], empty), "runs"))
        starts = materialize(starts.distinct(), "starts")
        # inside a run the line before is one too
        before = starts.select(F.col("k").alias("_k"), F.col("c").alias("_c"), (F.col("p") + 1).alias("_p"), "f.*").select(
            "_k", "_c", "_p", F.struct("k", (F.col("p") + 1).alias("p"), "c").alias("_f")
        )
        same = (F.col("k") == F.col("_k")) & (F.col("c") == F.col("_c")) & (F.col("p") == F.col("_p")) & (F.col("f") == F.col("_f"))
        heads = materialize(starts.join(before, same, "left_anti").withColumn("n", F.lit(0)), "heads")
        for j in range(len(rounds) - 1, -1, -1):
            ranks = rounds[j].select(F.col("k").alias("_k"), F.col("c").alias("_c"), F.col("p").alias("_p"), F.col("r").alias("_r"))
            other = ranks.toDF("_fk", "_fc", "_fp", "_fr")
            heads = heads.join(ranks, (F.col("k") == F.col("_k")) & (F.col("c") == F.col("_c")) & (F.col("p") + F.col("n") == F.col("_p")), "left")
            heads = heads.join(other, (F.col("f.k") == F.col("_fk")) & (F.col("f.c") == F.col("_fc")) & (F.col("f.p") + F.col("n") == F.col("_fp")), "left")
            step = F.when(F.col("_r") == F.col("_fr"), F.lit(1 << j)).otherwise(F.lit(0))
            heads = heads.select("k", "c", "p", "f", (F.col("n") + step).alias("n"))
            if j % 4 == 0 and j:  # plans stay short, however many rounds there were
                heads = materialize(heads, "heads")
        out = heads.select("k", "c", "p", "n", F.col("f.k").alias("source_k"), F.col("f.p").alias("source_p"))
        return keep(materialize(out, "runs"))


def drop_covered(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """(text without the lines that ``runs`` (p, n) cover, lines removed, maximal runs); lines without a word stay and are not numbered.

    Runs are marked by their ends, so their work is their number and that of
    the lines, however far they overlap.
    """
    lines = text.split("\n")
    edges = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edges, [x["p"] for x in runs], 1)
    np.add.at(edges, [x["p"] + x["n"] for x in runs], -1)
    gone = np.cumsum(edges) > 0
    marked, kept, p = gone.tolist(), [], 0
    for line in lines:
        if line.strip(_SPACE):
            if not marked[p]:
                kept.append(line)
            p += 1
        else:
            kept.append(line)
    return "\n".join(kept), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _gathered(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """(k, c, runs) of the texts that have any."""
    return maximal_runs(rows, run, words).groupBy("k", "c").agg(F.collect_set(F.struct("p", "n")).alias("runs"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, c, n_lines, n_removed, n_runs, kept): every row's text without later copies.

    A line goes if it is covered by ``run`` consecutive lines, or by fewer of
    ``words`` words together, (lines without a word are skipped, not counted)
    whose first copy, by (id, line number), is elsewhere and earlier.  Null texts
    are empty; null ids come last; rows that share an id are ordered by line
    number alone; repeated rows get equal results; no rows give an empty result.
    Ids must be of an integer type.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(_gathered(rows, run, words).hint("shuffle_hash"), ["k", "c"], "left").select("k", "c", "text", "runs")

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, removed, runs, kept = [], [], [], []
            for text, own in zip(batch.column(2), batch.column(3), strict=True):
                text, own = text.as_py(), own.as_py()
                left, a, b = drop_covered(text, own) if own else (text, 0, 0)
                for column, v in zip((n, removed, runs, kept), (text.count("\n") + 1, a, b, left), strict=True):
                    column.append(v)
            arrays = [batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (n, removed, runs)], pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "c", "n_lines", "n_removed", "n_runs", "kept"])

    schema = f"k {dict(rows.dtypes)['k']}, c long, n_lines long, n_removed long, n_runs long, kept string"
    return joined.mapInArrow(lean(run_), schema)


def without_later_copies(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """``docs`` with later copies of line runs deleted from ``text`` (and ``n_chars`` set anew).

    See :func:`dedup_lines`.  A document that had words and keeps none was a
    copy throughout and goes; null, empty and wordless texts stay as they are.
    Other columns are kept, whatever their names.
    """
    gathered = _gathered(keyed(docs), run, words).select(F.col("k").alias("_k"), F.col("c").alias("_c"), F.col("runs").alias("_runs"))
    docs, restore = aside(docs, "doc_id", "text", "n_chars")
    schema = docs.schema
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_dc": F.crc32(text.cast("binary"))})
    joined = rows.join(gathered.hint("shuffle_hash"), (F.col("_dk") == F.col("_k")) & (F.col("_dc") == F.col("_c")), "left")
    joined = joined.select(*docs.columns, "_runs")

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names = batch.schema.names
            texts, stay = batch.column(names.index("text")).to_pylist(), []
            for i, own in enumerate(batch.column(names.index("_runs"))):
                own = own.as_py()
                if own:
                    texts[i] = drop_covered(texts[i], own)[0]
                stay.append(not own or bool(texts[i].strip(_SPACE)))
            out = []
            for f in schema.names:
                column = batch.column(names.index(f))
                if f == "text":
                    column = pa.array(texts, pa.string())
                elif f == "n_chars":
                    column = pa.array([None if t is None else len(t) for t in texts], column.type)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=schema.names).filter(pa.array(stay, pa.bool_()))

    return restore(joined.mapInArrow(lean(run_), schema))


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256): runs of three lines and more, or of 50 words and more."""
    return dedup_lines(docs).select(doc_id(), "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(run: int = RUN, words: int = WORDS, docs: str = "documents") -> str:
    """DuckDB SQL of the query (ids are not null and not repeated in the driver's tables)."""
    word = "regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')"
    n_words = "len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"
    grams = ", ".join(f"lead(line, {i}) OVER w AS l{i}" for i in range(1, run))
    sums = ", ".join(f"sum(n) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {d - 1} FOLLOWING) AS w{d}" for d in range(1, run))
    starts = []
    for d in range(1, run + 1):
        names = ", ".join(["line", *[f"l{i}" for i in range(1, d)]])
        fits = " AND ".join(([f"l{d - 1} IS NOT NULL"] if d > 1 else []) + ([f"w{d} >= {words}"] if d < run else []))
        starts.append(f"SELECT doc_id, p, {d} AS d FROM (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY doc_id, p) AS i FROM grams WHERE {fits}) WHERE i > 1")
    return f"""WITH every AS (SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
      UNNEST(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM {docs}),
    numbered AS (SELECT doc_id, i, line, {n_words} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM every WHERE {word}),
    grams AS (SELECT doc_id, p, line, {grams}, {sums} FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    starts AS ({" UNION ALL ".join(starts)}),
    gone AS (SELECT DISTINCT doc_id, p + o AS p FROM starts, range(0, {run}) AS r(o) WHERE o < d),
    runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (b IS NULL OR b < p - 1) AS runs FROM
      (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM gone) GROUP BY 1),
    kept AS (SELECT e.doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.p IS NULL), '') AS kept
      FROM (SELECT e.doc_id, e.i, e.line, m.p FROM every e LEFT JOIN numbered m USING (doc_id, i)) e
      LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
    SELECT doc_id, n_lines, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_runs, sha256(kept) AS kept_sha256
    FROM kept LEFT JOIN runs USING (doc_id)"""


ORACLE = oracle()
