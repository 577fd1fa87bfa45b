"""Tags: cleaning raw suggestions, topic terms, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions.sql import each, extract, extract_all, keep, lits, substitute
from feedlake.functions.text import strip
from feedlake.session import materialise


def clean_tags(raw: str) -> str:
    """Raw suggestions, one per line, to at most five clean tags in order."""

    def tag(line: str) -> str:
        bare = substitute(f"lower({strip(line)})", r"^[\p{Nd}.\-*•]+(?U:\s*)")
        return extract(substitute(bare, r"(?U)[^\w\s-]"), r"(?U)^\s*(\S+)")

    tags = keep(
        each(f"split({strip(raw)}, '\\n')", tag),
        lambda t: f"length({t}) BETWEEN {fixed.TAG_MIN_CHARS} AND {fixed.TAG_MAX_CHARS}",
    )
    return f"slice(array_distinct({tags}), 1, {fixed.MAX_TAGS})"


def merge_tags(own: str, new: str) -> str:
    """Both tag lists without repeats, in alphabetical order."""
    return f"array_sort(array_union(coalesce({own}, array()), coalesce({new}, array())))"


#: Terms whose weights every task holds, a few MB; all rarer ones are joined.
_COMMON_TERMS = 100_000


def text_terms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Term frequencies of each text for itself: ``key``, ``term``, ``tf``. Whole texts are read.

    A text's own words are sorted and counted within its row, so no task holds more than one text's words and nothing is
    shuffled. Where a key comes with several texts, so do its terms; ``added_up`` puts them together.
    """
    token = r"[\p{L}][\p{L}\p{N}-]{2,}"
    words = keep(
        extract_all(f"lower({text})", token),
        lambda t: f"length({t}) <= {fixed.TAG_MAX_CHARS} AND {t} NOT IN ({lits(fixed.STOP_WORDS)})",
    )
    begins = keep("sequence(0, size(_words) - 1)", lambda i: f"NOT (get(_words, {i}) <=> get(_words, {i} - 1))")
    return (
        texts.selectExpr(key, f"sort_array({words}) AS _words")
        .selectExpr(key, "_words", f"{begins} AS _begins")
        .select(key, "_words", "_begins", F.posexplode_outer("_begins").alias("_k", "_at"))
        .filter("_at IS NOT NULL")
        .selectExpr(
            key, "get(_words, _at) AS term", "CAST(coalesce(get(_begins, _k + 1), size(_words)) - _at AS BIGINT) AS tf"
        )
    )


def added_up(terms: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and term, where ``texts`` has a row of ``keys`` for each text that ``terms`` were counted in.

    Only keys that come more than once are grouped; all other rows stay where they are. Null keys are one key.
    """
    counts = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    again = materialise(counts.select(*[F.col(k).alias(f"_{k}") for k in keys]), "repeated")
    if again.isEmpty():
        return terms
    same = reduce(Column.__and__, [terms[k].eqNullSafe(again[f"_{k}"]) for k in keys])
    several = terms.join(again, same, "left_semi").groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    return terms.join(again, same, "left_anti").unionByName(several)


def topic_terms(texts: DataFrame, key: str, text: str = "text", top: int = fixed.MAX_TAGS) -> DataFrame:
    """The ``top`` terms of each text by tf-idf: ``key``, ``rank``, ``term``, ``score``.

    ``idf = ln((1 + N) / (1 + df)) + 1``; scores are rounded to six digits before
    ranking and ties go to the smaller term. The terms of the texts are counted once and written,
    as both the document counts and the ranking read them. The final rank is per text.
    """
    tf = added_up(materialise(text_terms(texts, key, text), "terms"), texts.select(key), [key])
    n_texts = texts.agg(F.count(F.lit(1))).scalar()
    return ranked_terms(tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_texts, key, top)


def ranked_terms(tf: DataFrame, df: DataFrame, n_texts: int, key: str, top: int = fixed.MAX_TAGS) -> DataFrame:
    """The ``top`` terms of each text, from term counts and document counts (``term``, ``df``): ``key``, ``rank``, ``term``, ``score``.

    Most rows hold one of the most common terms. Those get their weights where they are, so no common term is a hot
    key of the join, and what cannot be among the ``top`` leaves before the shuffle. Rarer terms are joined. Rounding is
    dear; scores of words that a text has once or twice, which most are, are rounded once a term.
    """
    df = materialise(df, "df")
    common = materialise(df.orderBy(F.desc("df"), "term").limit(_COMMON_TERMS), "common")

    def weights(of: DataFrame) -> DataFrame:
        idf = of.select("term", (F.log((1 + n_texts) / (1 + F.col("df"))) + 1).alias("idf"))
        return idf.select("*", *[F.round(n * F.col("idf"), 6).alias(f"_score_{n}") for n in (1, 2)])

    near = tf.join(F.broadcast(weights(common)), "term")
    far = tf.join(F.broadcast(common.select("term")), "term", "left_anti").join(weights(df), "term")
    score = F.when(F.col("tf") == 1, F.col("_score_1")).when(F.col("tf") == 2, F.col("_score_2")).otherwise(F.round(F.col("tf") * F.col("idf"), 6))
    scored = near.unionByName(far).select(key, "term", score.alias("score"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "term")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select(key, "rank", "term", "score")
    )


def add_topics(items: DataFrame, topics: DataFrame) -> DataFrame:
    """Merge topic terms into the items' own tags (at most ``MAX_TAGS`` new per item)."""
    new = topics.groupBy("id").agg(F.collect_set("term").alias("_new"))
    return items.join(new, "id", "left").selectExpr(
        *[f"{merge_tags('tags', '_new')} AS tags" if c == "tags" else c for c in items.columns]
    )


def tag_rollup(items: DataFrame) -> DataFrame:
    """Items per feed and tag."""
    return (
        items.select("feed", F.explode_outer("tags").alias("tag"))
        .filter("tag <> ''")
        .groupBy("feed", "tag")
        .agg(F.count(F.lit(1)).alias("items"))
    )
