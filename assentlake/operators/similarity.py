"""Character n-gram TF-IDF cosine: the matcher the phrase lexicon is compared with."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assentlake import fixed
from assentlake.functions.arrays import leading
from assentlake.functions.binding import bind, once
from assentlake.functions.text import WHITESPACE_CLASS, strip_fences, trim_all
from assentlake.operators.detect import with_spans
from assentlake.session import staged
from assentlake.sources.lexicon import Matcher


def sample_messages(messages: DataFrame, harnesses: Sequence[str], n: int) -> DataFrame:
    """The first n messages of the chosen agents."""
    return messages.where(F.col("harness").isin(*harnesses)).orderBy("msg_id").limit(n)


def chunks_of(text: Column) -> Column:
    """Sentence-like pieces of 2 to 40 characters, fences cut out."""
    pieces = F.transform(F.split(strip_fences(text), r"[。！？!?\n]+", -1), trim_all)
    return F.filter(pieces, lambda c: F.length(c).between(fixed.CHUNK_MIN, fixed.CHUNK_MAX))


def sentence_chunks(messages: DataFrame) -> DataFrame:
    """(msg_id, chunk_no, chunk)."""
    # Outer generators here and below: the inner ones would compute each array twice.
    exploded = messages.select("msg_id", F.posexplode_outer(chunks_of(F.col("text"))).alias("chunk_no", "chunk"))
    return exploded.where(F.col("chunk").isNotNull())


def _clean(text: Column) -> Column:
    return trim_all(F.lower(F.regexp_replace(strip_fences(text), f"[{WHITESPACE_CLASS}]+", " ")))


def _grams(clean: Column) -> Column:
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(clean) - (n - 1))
        return F.when(
            F.length(clean) >= n, F.transform(starts, lambda i: F.substring(clean, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of_size(n) for n in fixed.NGRAM_SIZES))


def _terms(grams: Column) -> Column:
    """(gram, tf) of each different gram: equal ones stand together once they are sorted."""

    def counted(ordered: Column) -> Column:
        n = F.size(ordered)
        heads = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return bind(
            heads,
            lambda at: F.transform(
                at,
                lambda h, k: F.struct(
                    F.get(ordered, h).alias("gram"), (F.coalesce(F.get(at, k + 1), n) - h).cast("bigint").alias("tf")
                ),
            ),
        )

    return bind(grams, lambda g: F.when(F.size(g) > 0, bind(F.array_sort(g), counted)))


def char_ngrams(rows: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, gram, tf): 2- and 3-grams of the lower-case text with their counts.

    Counts are taken inside the row, so nothing is shuffled.
    """
    # The text is cleaned once, not again for every gram.
    terms = _terms(bind(_clean(F.col(text)), _grams))
    return rows.select(*key, F.inline_outer(terms)).where(F.col("gram").isNotNull())


def _tf_weight(tf: Column) -> Column:
    return F.lit(1.0) + F.log(tf.cast("double"))


def _idf(n_phrases: Column, df: Column) -> Column:
    return F.log((n_phrases + 1).cast("double") / (df + 1).cast("double")) + 1.0


#: A phrase has some hundred grams; so many phrases make a task of a few hundred thousand rows.
PHRASES_PER_TASK = 5000


def tfidf_reference(phrases: DataFrame) -> DataFrame:
    """Weights of reference phrases (ref_no, phrase): one row per phrase and gram.

    Phrases are dealt out before they become grams: a file of phrases is small, their grams are
    many. The rows of a phrase stay together from there on. The frequencies are staged, so their
    real size decides: few are broadcast and grams are not shuffled.
    """
    n = phrases.count()
    tf = char_ngrams(phrases.repartition(n // PHRASES_PER_TASK + 1, "ref_no"), ["ref_no", "phrase"], "phrase")
    df = staged(tf.groupBy("gram").agg(F.count("*").alias("df")), "frequencies")
    weighted = (
        tf.join(df, "gram")
        .withColumn("idf", _idf(F.lit(n), F.col("df")))
        .withColumn("weight", _tf_weight(F.col("tf")) * F.col("idf"))
    )
    # The group is one phrase, a few grams.
    of_phrase = Window.partitionBy("ref_no")
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(of_phrase))
    return weighted.withColumn("norm", norm).select(
        "ref_no", "phrase", "gram", "tf", "df", "idf", "weight", "norm"
    )


@dataclass(frozen=True)
class References:
    """Reference phrases as inverted lists, in the order of their grams: a constant of the plan.

    Of each gram: its idf, the phrases that hold it with their weights (for vectors of length
    one), and the greatest of these weights.
    """

    phrases: tuple[str, ...]
    lists: tuple[dict, ...]

    @classmethod
    def of(cls, spark: SparkSession, phrases: Sequence[str] = fixed.REFERENCE_PHRASES) -> References:
        """``phrases`` is a list written by hand, so its lists fit into the query plan."""
        rows = spark.createDataFrame(list(enumerate(phrases)), "ref_no int, phrase string")
        lists: dict[str, dict] = {}
        for r in tfidf_reference(rows).orderBy("ref_no").collect():
            entry = lists.setdefault(r.gram, {"gram": r.gram, "idf": r.idf, "top": 0.0, "phrases": []})
            weight = r.weight / r.norm
            entry["phrases"].append({"ref_no": r.ref_no, "weight": weight})
            entry["top"] = max(entry["top"], weight)
        return cls(tuple(phrases), tuple(lists[g] for g in sorted(lists, key=str.encode)))

    @property
    def grams(self) -> Column:
        return F.from_json(F.lit(json.dumps([e["gram"] for e in self.lists], ensure_ascii=False)), "array<string>")

    @property
    def literal(self) -> Column:
        return F.from_json(
            F.lit(json.dumps(self.lists, ensure_ascii=False)),
            "array<struct<gram:string,idf:double,top:double,phrases:array<struct<ref_no:int,weight:double>>>>",
        )


#: Digits at which scores are compared: equal ones must not depend on the order of a sum.
SCORE_DIGITS = 9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda n, x: n + x)


def _weighed(grams: Column, refs: References) -> Column:
    """struct(known, norm, bound) of a chunk; NULL if it shares no gram with any phrase.

    ``known`` are its terms that phrases hold, with their weights and lists; no score of the
    chunk can be above ``bound``.
    """
    unseen = _idf(F.lit(len(refs.phrases)), F.lit(0))

    def of_terms(terms: Column, shared: Column) -> Column:
        found = F.transform(
            F.filter(terms, lambda t: F.array_contains(shared, t["gram"])),
            lambda t: bind(
                F.get(refs.literal, leading(refs.literal, lambda e: e["gram"] < t["gram"])),
                lambda e: F.struct(
                    _tf_weight(t["tf"]).alias("tf"),
                    (_tf_weight(t["tf"]) * e["idf"]).alias("weight"),
                    e["top"].alias("top"),
                    e["phrases"].alias("phrases"),
                ),
            ),
        )

        def measured(known: Column) -> Column:
            squares = _sum(F.transform(terms, lambda t: _tf_weight(t["tf"]) * _tf_weight(t["tf"])))
            rest = squares - _sum(F.transform(known, lambda k: k["tf"] * k["tf"]))
            norm = F.sqrt(rest * unseen * unseen + _sum(F.transform(known, lambda k: k["weight"] * k["weight"])))
            most = _sum(F.transform(known, lambda k: k["weight"] * k["top"]))
            return F.struct(known.alias("known"), norm.alias("norm"), (most / norm).alias("bound"))

        return bind(found, measured)

    shared = F.array_intersect(grams, refs.grams)
    return bind(
        shared, lambda both: F.when(F.size(both) > 0, bind(_terms(grams), lambda terms: of_terms(terms, both)))
    )


def _score(weighed: Column) -> Column:
    """struct(score, ref_no) of the most similar phrase of a chunk; ties go to the first."""
    products = F.flatten(
        F.transform(
            weighed["known"],
            lambda k: F.transform(
                k["phrases"], lambda p: F.struct(p["ref_no"].alias("ref_no"), (k["weight"] * p["weight"]).alias("x"))
            ),
        )
    )

    def best(ordered: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["ref_no"] != F.get(ordered, i - 1)["ref_no"]),
        )

        def of_phrase(at: Column) -> Column:
            return F.array_max(
                F.transform(
                    at,
                    lambda h, k: F.struct(
                        F.round(
                            F.aggregate(
                                F.slice(ordered, h + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - h),
                                F.lit(0.0),
                                lambda n, p: n + p["x"],
                            )
                            / weighed["norm"],
                            SCORE_DIGITS,
                        ).alias("score"),
                        (-F.get(ordered, h)["ref_no"]).alias("order"),
                    ),
                )
            )

        return bind(
            bind(heads, of_phrase),
            lambda top: F.struct(top["score"].alias("score"), (-top["order"]).alias("ref_no")),
        )

    return bind(F.array_sort(products), best)


def _best_of_chunks(chunks: Column, refs: References) -> Column:
    """struct(score, ref_no) over the chunks of a message; ties go to the first chunk.

    A chunk whose bound is not above the best score so far is not compared with any phrase.
    """
    # Rounding may lift a score above an unrounded bound.
    slack = 10.0 ** -SCORE_DIGITS

    def better(best: Column, chunk: Column) -> Column:
        def compare(weighed: Column) -> Column:
            hopeless = weighed.isNull() | (weighed["bound"] + F.lit(slack) < best["score"])
            return F.when(hopeless, best).otherwise(
                bind(_score(weighed), lambda own: F.when(own["score"] > best["score"], own).otherwise(best))
            )

        return bind(bind(bind(_clean(chunk), _grams), lambda grams: _weighed(grams, refs)), compare)

    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("ref_no"))
    return F.aggregate(chunks, nothing, better)


def _spread(slim: DataFrame) -> DataFrame:
    """The rows dealt anew: long texts arrive in few tasks, and the work on them is in the chunks."""
    return slim.repartition(slim.sparkSession.sparkContext.defaultParallelism)


def _scored(chunked: DataFrame, refs: References) -> DataFrame:
    """Replace ``chunks`` by ``phrase`` and ``score``."""
    names = F.array(*(F.lit(p) for p in refs.phrases))
    best = once(_spread(chunked), "_best", _best_of_chunks(F.col("chunks"), refs))
    return (
        best.withColumn("score", F.col("_best.score"))
        .withColumn("phrase", F.coalesce(F.get(names, F.col("_best.ref_no")), F.lit("")))
        .drop("_best", "chunks")
    )


def cosine_best(messages: DataFrame, refs: References) -> DataFrame:
    """Replace ``text`` by ``phrase`` and ``score``: the best reference over all its chunks.

    The lists of the references are constants. Only the chunks are dealt to other tasks, once.
    """
    return _scored(messages.withColumn("chunks", chunks_of(F.col("text"))).drop("text"), refs)


def _excerpt(text: Column) -> Column:
    """The beginning of a text, each run of white space as one space; the rest is not looked at."""
    space = f"[{WHITESPACE_CLASS}]"
    front = F.regexp_extract(text, f"(?s)^(?:{space}++|[^{WHITESPACE_CLASS}]){{0,{fixed.EXCERPT_COSINE}}}+", 0)
    return F.regexp_replace(front, f"{space}+", " ")


def compare_matchers(messages: DataFrame, matcher: Matcher, refs: References) -> DataFrame:
    """(msg_id, n_hits, score, phrase, phrases, excerpt): both matchers side by side.

    ``phrases`` are the lexicon's hits in their order of rank, ``excerpt`` the beginning of the
    text. Both matchers see each text once; only what is left of it moves.
    """
    spanned = with_spans(messages.select("msg_id", "text"), matcher)
    ranked = F.array_sort(F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s["rank"], s["start"], s["phrase"])))
    slim = spanned.select(
        "msg_id",
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_hits"),
        F.transform(ranked, lambda s: s["phrase"]).alias("phrases"),
        _excerpt(F.col("text")).alias("excerpt"),
        chunks_of(F.col("text")).alias("chunks"),
    )
    return _scored(slim, refs)


def matcher_sweep(
    compared: DataFrame, thresholds: Sequence[float] = fixed.COSINE_THRESHOLDS
) -> DataFrame:
    """Agreement of the two matchers at each cosine threshold."""
    cosine = F.col("score") >= F.col("threshold")
    regex = F.col("n_hits") > 0
    counted = (
        compared.select("n_hits", "score", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
        .groupBy("threshold")
        .agg(
            F.count_if(regex).alias("regex_hits"),
            F.count_if(cosine).alias("cosine_hits"),
            F.count_if(cosine & regex).alias("agree"),
            F.count_if(~cosine & regex).alias("missed"),
            F.count_if(cosine & ~regex).alias("cosine_only"),
        )
    )
    return counted.withColumn(
        "precision", F.coalesce(F.round(F.try_divide("agree", "cosine_hits"), 4), F.lit(0.0))
    ).withColumn("recall", F.coalesce(F.round(F.try_divide("agree", "regex_hits"), 4), F.lit(0.0)))


def matcher_disagreements(compared: DataFrame, threshold: float = 0.7, k: int = 12) -> DataFrame:
    """The k best rows only cosine finds, and k rows only the lexicon finds, for reading.

    With the score and the reference of one matcher, the phrases of the other, and an excerpt.
    """
    only_cosine = (
        compared.where((F.col("score") >= threshold) & (F.col("n_hits") == 0))
        .orderBy(F.col("score").desc(), "msg_id")
        .limit(k)
        .withColumn("side", F.lit("cosine_only"))
    )
    dropped = (
        compared.where((F.col("score") < threshold) & (F.col("n_hits") > 0))
        .orderBy("msg_id")
        .limit(k)
        .withColumn("side", F.lit("dropped"))
        .withColumn("excerpt", F.left("excerpt", F.lit(fixed.EXCERPT_LEXICON)))
    )
    return only_cosine.unionByName(dropped)
