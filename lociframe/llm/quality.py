"""Text quality: measures of every document, their ranks by language, and forms other than prose.

Measures are ranked exactly among all documents of the same language, and among
all documents.  The different values of a measure are counted, range-partitioned
and sorted; running counts within the partitions and the partitions' offsets give
for each value how many documents lie at or beyond it.  A document's outlier score
for a form is the weighted sum of the logarithms of these tail probabilities over
all measures.  The weights and the cut-off are fitted on a bounded sample of
labelled documents; nothing but the ranks goes into them, so a document's form is
decided by how it stands among the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.measures import NAMES, PAIR_BUCKETS, SIGN_BUCKETS, WORD_BUCKETS, Batch, Usage, measure, slices
from lociframe.plans import Workspace, skew_join, within

#: The language group of all documents, beside their own.
ALL = "*"
PROSE = "prose"
#: Forms other than prose, and the lines that a text of the form has at least (fixed values of the task).
FORMS = {"list": 4, "table": 4, "junk": 1}
#: A word is known if a thousandth of the documents of a language have it, and common if a twentieth has it; two have it at least.
KNOWN_SHARE, COMMON_SHARE, LEAST_DOCUMENTS = 1 / 1000, 1 / 20, 2
#: The most labelled documents that are taken to fit weights; of more those with the smallest hash.
MOST_LABELS = 4_000
#: Weight of the squares of the weights, and steps, of the fit.
SHRINK, STEPS = 1e-5, 400
#: Different values of measures up to which their ranks are broadcast.
BROADCAST_VALUES = 400_000
#: Different words that a task counts before it sends them on.
HELD_WORDS = 400_000


def language() -> Column:
    """The language of a document without region and letter case; ``und`` if it has none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract("lang", "\\A\\s*(\\p{L}+)", 1)), F.lit("")), F.lit("und"))


_WORD, _DOCUMENT, _PAIR, _SIGN = range(4)
_COUNTS = "kind tinyint, language string, key bigint, n bigint"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each word, documents, sign pairs and signs of ``(language, text)``, counted within this task."""
    pairs, signs = np.zeros(PAIR_BUCKETS, dtype=np.int64), np.zeros(SIGN_BUCKETS, dtype=np.int64)
    codes: dict[str, int] = {}
    documents: list[int] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(kind: int, languages, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int8)), pa.array(languages, pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "language", "key", "n"])

    def words() -> Iterator[pa.RecordBatch]:
        names = np.array(list(codes), dtype=object)
        of, hashes = np.concatenate([o for o, _ in held]), np.concatenate([h for _, h in held])
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))
        yield rows(_WORD, names[of[first]], hashes[first].view(np.int64), np.diff(np.append(first, len(hashes))))
        held.clear()

    for batch in batches:
        texts = batch.column(1).to_pylist()
        which = np.array([codes.setdefault(name, len(codes)) for name in batch.column(0).to_pylist()], dtype=np.int32)
        documents.extend([0] * (len(codes) - len(documents)))
        for code, n in zip(*np.unique(which, return_counts=True)):
            documents[code] += int(n)
        for lo, hi in slices(texts):
            part = Batch(texts[lo:hi])
            text, hashes = part.word_sets
            held.append((which[lo:hi][text], hashes))
            pair, lone, counted = part.pairs
            pairs += np.bincount(pair[counted], minlength=PAIR_BUCKETS)
            signs += np.bincount(lone[counted], minlength=SIGN_BUCKETS)
            if sum(len(h) for _, h in held) >= HELD_WORDS:
                yield from words()
    if held:
        yield from words()
    if documents:
        yield rows(_DOCUMENT, list(codes), np.zeros(len(codes), dtype=np.int64), np.array(documents))
    for kind, counts in ((_PAIR, pairs), (_SIGN, signs)):
        seen = np.flatnonzero(counts)
        yield rows(kind, [ALL] * len(seen), seen, counts[seen])


def usage(ws: Workspace, documents: DataFrame) -> Usage:
    """What words are known and common in some language of the corpus, and how often signs follow each other.

    All documents are counted.  The result has a fixed size, whatever theirs: known words are marked in
    WORD_BUCKETS places, sign pairs and signs are counted in as many.
    """
    counted = documents.select(language().alias("language"), "text").mapInArrow(_counts, _COUNTS)
    counts = ws.store(counted.groupBy("kind", "language", "key").agg(F.sum("n").alias("n")), "counts")
    of = counts.where(F.col("kind") == _DOCUMENT).select("language", F.col("n").alias("documents"))
    words = counts.where((F.col("kind") == _WORD) & (F.col("n") >= LEAST_DOCUMENTS)).join(of, "language").where(F.col("n") >= F.col("documents") * KNOWN_SHARE)
    places = words.groupBy(F.col("key").bitwiseAND(F.lit(WORD_BUCKETS - 1)).alias("place")).agg(F.max(F.when(F.col("n") >= F.col("documents") * COMMON_SHARE, 3).otherwise(1)).alias("mark"))
    # each of the three has as many rows as buckets at most
    marks = places.select(F.lit(_WORD).alias("kind"), "place", F.col("mark").cast("long").alias("n"))
    signs = counts.where(F.col("kind").isin(_PAIR, _SIGN)).select("kind", F.col("key").alias("place"), "n")
    fixed = marks.unionByName(signs).toArrow()
    kind, place, n = (fixed.column(c).to_numpy() for c in ("kind", "place", "n"))
    tables = {_WORD: np.zeros(WORD_BUCKETS, dtype=np.uint8), _PAIR: np.zeros(PAIR_BUCKETS), _SIGN: np.zeros(SIGN_BUCKETS)}
    for k, table in tables.items():
        table[place[kind == k]] = n[kind == k]
    return Usage(tables[_WORD], tables[_PAIR], tables[_SIGN])


def measured(documents: DataFrame, corpus: Usage) -> DataFrame:
    """``row, doc_id, language`` and the measures of every document, whole texts each.

    Null and empty texts have measures of 0.  ``documents`` has ``doc_id, text, lang``; ``row`` numbers its rows.
    """
    known = documents.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                part, values = batch.slice(lo, hi - lo), measure(texts[lo:hi], known.value)
                number = pa.array(np.arange(row, row + hi - lo, dtype=np.int64))
                row += hi - lo
                yield pa.RecordBatch.from_arrays([number, part.column(0), part.column(1), *[pa.array(values[:, k]) for k in range(len(NAMES))]], names=["row", "doc_id", "language", *NAMES])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", language().alias("language"), "text").mapInArrow(run, f"row bigint, doc_id {kind}, language string, " + ", ".join(f"{n} int" for n in NAMES))


def _melted(stats: DataFrame, *keep: str) -> DataFrame:
    """One row a document and measure, by its number in NAMES."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(m).alias("value")) for k, m in enumerate(NAMES)])).alias("m")
    return stats.select(*keep, "language", long).select(*keep, "language", "m.measure", "m.value")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running counts of sorted ``(measure, language, value, n)`` within this partition."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    group, so_far = None, 0
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        language, number = batch.column("language").to_pylist(), batch.column("measure").to_numpy(zero_copy_only=False)
        out = np.cumsum(n)
        change = np.flatnonzero([l != k for l, k in zip(language[1:], language)] | (number[1:] != number[:-1])) + 1 if len(n) > 1 else np.zeros(0, dtype=np.int64)
        first = np.append(0, change)
        if len(n):
            base = np.where(first > 0, out[first - 1], 0)
            if (language[0], number[0]) == group:
                base[0] = -so_far
            out = out - np.repeat(base, np.diff(np.append(first, len(n))))
            group, so_far = (language[-1], number[-1]), int(out[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int64)), pa.array(np.full(len(n), part, dtype=np.int32))], names=[*batch.schema.names, "running", "part"])


def tail_probabilities(ws: Workspace, stats: DataFrame) -> DataFrame:
    """``measure, language, value, upper, lower``: shares of documents at or beyond each value, by language and over ALL."""
    own = _melted(stats).groupBy("measure", "language", "value").agg(F.count("*").alias("n"))
    both = own.select("measure", F.explode(F.array("language", F.lit(ALL))).alias("language"), "value", "n")
    counts = ws.store(both.groupBy("measure", "language", "value").agg(F.sum("n").alias("n")), "values")
    ordered = counts.repartitionByRange("measure", "language", "value").sortWithinPartitions("measure", "language", "value")
    running = ws.store(ordered.mapInArrow(_running, "measure int, language string, value int, n bigint, running bigint, part int"), "running")
    # one row for each measure, language and partition
    sums = running.groupBy("measure", "language", "part").agg(F.max("running").alias("total"))
    per_group = sums.groupBy("measure", "language").agg(F.sum("total").alias("documents"), F.collect_list(F.struct("part", "total")).alias("parts"))
    placed = running.join(per_group, ["measure", "language"])
    before = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda total, p: total + p["total"])
    at_most = before + F.col("running")
    return placed.select("measure", "language", "value", ((F.col("documents") - at_most + F.col("n")) / F.col("documents")).alias("upper"), (at_most / F.col("documents")).alias("lower"))


def tail_scores(ws: Workspace, tails: DataFrame) -> DataFrame:
    """``measure, language, value, upper, lower``: the mean of -log10 of the tail probabilities in the language and over ALL."""
    over_all = tails.where(F.col("language") == ALL).select("measure", "value", F.col("upper").alias("all_upper"), F.col("lower").alias("all_lower"))
    both = tails.where(F.col("language") != ALL).join(over_all, ["measure", "value"])
    return ws.store(both.select("measure", "language", "value", *[(-F.log10(F.col(s) * F.col(f"all_{s}")) / 2).alias(s) for s in ("upper", "lower")]), "ranks")


def _looked_up(long: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows ``(row, measure, language, value)`` joined with the ranks of their values."""
    key = ["measure", "language", "value"]
    if within(ranks, BROADCAST_VALUES):
        return long.join(F.broadcast(ranks), key)
    cell = F.xxhash64(*key)
    others = ranks.select(cell.alias("cell"), *[F.col(c).alias(f"its_{c}") if c in key else F.col(c) for c in ranks.columns])
    joined = skew_join(long.withColumn("cell", cell), others, "cell", spread_by="row")
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"its_{c}"))
    return joined.where(same).drop("cell", *[f"its_{c}" for c in key])


def fit_weights(features: np.ndarray, forms: list[str], shrink: float = SHRINK, steps: int = STEPS) -> dict[str, np.ndarray]:
    """For each labelled form other than prose its cut-off and weights, by which it is told from prose.

    ``features`` has a row a document.  The likelihood of the labels is climbed along accelerated gradients.
    Without prose, or without other forms, nothing can be told and the result is empty.
    """
    told = [f for f in (PROSE, *FORMS) if f in forms]
    if len(told) < 2 or told[0] != PROSE:
        return {}
    x = np.column_stack([np.ones(len(features)), features])
    y = np.array([told.index(f) for f in forms])
    wanted = np.eye(len(told))[y]

    def state(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        loss = (np.log(total[:, 0]) - z[np.arange(len(y)), y]).mean() + shrink * (w**2).sum() / 2
        return loss, x.T @ (p / total - wanted) / len(y) + shrink * w

    weights = ahead = np.zeros((x.shape[1], len(told)))
    rate, momentum = 1.0, 1.0
    loss, slope = state(ahead)
    for _ in range(steps):
        while state(ahead - rate * slope)[0] > loss - rate * (slope**2).sum() / 2 + 1e-12 and rate > 1e-9:
            rate /= 2
        further = ahead - rate * slope
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = further + (momentum - 1) / following * (further - weights)
        weights, momentum, rate = further, following, rate * 1.05
        loss, slope = state(ahead)
    return {f: weights[:, k] - weights[:, 0] for k, f in enumerate(told) if k}


def labelled_weights(stats: DataFrame, ranks: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Weights fitted on at most MOST_LABELS labelled documents, whose ranks are collected.

    Null ids, forms not known and repeated rows don't count.
    """
    usable = labels.select("doc_id", "text_form").where(F.col("text_form").isin(PROSE, *FORMS)).distinct()
    some = usable.orderBy(F.xxhash64("doc_id"), "text_form").limit(MOST_LABELS)
    shown = stats.join(F.broadcast(some), "doc_id").drop("row").distinct().orderBy(F.xxhash64("doc_id"), "text_form").limit(MOST_LABELS)
    shown = shown.withColumn("row", F.monotonically_increasing_id())
    got = _looked_up(_melted(shown, "row", "text_form"), ranks).select("row", "text_form", "measure", "upper", "lower").toPandas()
    rows, at = np.unique(got["row"].to_numpy(), return_inverse=True)
    features = np.zeros((len(rows), 2 * len(NAMES)))
    number = got["measure"].to_numpy()
    features[at, 2 * number], features[at, 2 * number + 1] = got["upper"], got["lower"]
    forms = np.empty(len(rows), dtype=object)
    forms[at] = got["text_form"].to_numpy()
    return fit_weights(features, list(forms))


def outlier_scores(stats: DataFrame, ranks: DataFrame, weights: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``row``, the columns ``keep`` of ``stats`` and ``list_score``, ``table_score``, ``junk_score`` of every document.

    A score is the cut-off plus the weighted tails of all measures; above 0 the document is rather of the form than prose.
    The score of a form without weights is null.
    """
    spark = stats.sparkSession
    sides = [f"{f}_{s}" for f in FORMS for s in ("upper", "lower")]
    nothing = np.zeros(1 + 2 * len(NAMES))
    table = [(k, *[float(weights.get(f, nothing)[1 + 2 * k + s]) for f in FORMS for s in (0, 1)]) for k in range(len(NAMES))]
    # as many rows as measures
    each = spark.createDataFrame(table, "measure int, " + ", ".join(f"{c} double" for c in sides))
    parts = ranks.join(F.broadcast(each), "measure").select("measure", "language", "value", *[(F.col("upper") * F.col(f"{f}_upper") + F.col("lower") * F.col(f"{f}_lower")).alias(f) for f in FORMS])
    summed = _looked_up(_melted(stats, "row", *keep), parts).groupBy("row", *keep).agg(*[F.sum(f).alias(f) for f in FORMS])
    return summed.select("row", *keep, *[(F.col(f) + float(weights[f][0]) if f in weights else F.lit(None).cast("double")).alias(f"{f}_score") for f in FORMS])


def _prepared(documents: DataFrame, labels: DataFrame):
    ws = Workspace(documents.sparkSession, "quality")
    stats = ws.store(measured(documents, usage(ws, documents)), "measures")
    ranks = tail_scores(ws, tail_probabilities(ws, stats))
    return stats, ranks, labelled_weights(stats, ranks, labels)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All measures and outlier scores of every document.

    Of documents repeated under one ``doc_id`` each row is ranked and scored; rows without ``doc_id`` are
    ranked, but left out of the result.  An empty table has no rows.
    """
    stats, ranks, weights = _prepared(documents, labels)
    scores = outlier_scores(stats, ranks, weights)
    return stats.where(F.col("doc_id").isNotNull()).join(scores, "row").drop("row")


def forms(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text_form)`` of the documents that aren't prose.

    ``documents`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, text_form``.  A document takes the form
    with the highest outlier score, if that is above 0 and the text has the lines that such a form has at
    least.  Null, empty and blank texts have none.  A form without a labelled document, or all forms where no
    prose is labelled, can't be told and aren't reported.  Repeated rows come out once.
    """
    stats, ranks, weights = _prepared(documents, labels)
    scores = outlier_scores(stats.where(F.col("doc_id").isNotNull() & (F.col("n_signs") > 0)), ranks, weights, "doc_id", "n_lines")
    able = [F.struct(F.when(F.col("n_lines") >= least, F.col(f"{f}_score")).alias("score"), F.lit(f).alias("text_form")) for f, least in FORMS.items()]
    best = F.array_max(F.filter(F.array(*able), lambda s: s["score"] > 0))
    return scores.select("doc_id", best["text_form"].alias("text_form")).where(F.col("text_form").isNotNull()).distinct()
