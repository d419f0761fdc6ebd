"""Language of pages by Bayesian fusion of text, markup, address suffix and host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import common

#: Labelled documents of each language that the text model is fitted on, about (those with the smallest hash of doc_id).
LANGUAGE_ROWS = 1_500
#: Affixes of each language in the text model: its most frequent ones.
LANGUAGE_AFFIXES = 5_000
#: Numbers in the text model up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000
#: Affixes are not independent: a page's text counts as at most so many of them.
TEXT_WEIGHT = 40
#: Pages that a parent's shares count for when they smooth a host or domain.
SMOOTHING = 5.0


def affixes(text: Column) -> Column:
    """First and last three letters of every word, marked as such."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.array(F.concat(F.lit("^"), F.left(w, F.lit(3))), F.concat(F.lit("$"), F.right(w, F.lit(3))))))


def visible_text(html: Column) -> Column:
    # Possessive steps, so an element without an end costs its length once; it reaches to the end of the page.
    mark = r"(?is)<script\b(?:(?!</script).)*+(?:</script\s*>?|\z)|<style\b(?:(?!</style).)*+(?:</style\s*>?|\z)|<!--(?:(?!-->).)*+(?:-->|\z)"
    text = F.regexp_replace(html, mark, " ")
    return F.regexp_replace(text, r"<[^>]*>|&[A-Za-z0-9#]+;", " ")


def text_model(documents: DataFrame, language_rows: int = LANGUAGE_ROWS) -> tuple[list[str], DataFrame]:
    """Languages, and per affix an array with the log likelihood under each of them.

    Languages are those of all labelled documents, counted by a grouped aggregation; each has a sample and affixes of
    its own, so a rare one is not crowded out.
    """
    known = documents.select("doc_id", "text", F.lower("lang").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(rows)
    if not languages:
        return [], documents.sparkSession.createDataFrame([], "affix string, likely array<double>")
    shares = documents.sparkSession.createDataFrame([(x, min(10**6, 10**6 * language_rows // n + 1)) for x, n in rows.items()], "lang string, share long")
    sample = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < F.col("share"))
    counts = common.stored(
        sample.select("lang", F.explode(affixes(F.col("text"))).alias("affix")).groupBy("lang", "affix").agg(F.count(F.lit(1)).alias("n"))
    )
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "affix")
    chosen = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LANGUAGE_AFFIXES).select("affix").distinct()
    seen = counts.join(chosen, "affix").groupBy("affix").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    likely = [F.log((F.coalesce(F.col("n")[x], F.lit(0)) + 0.5) / F.lit(float(total.get(x, 0) + LANGUAGE_AFFIXES * len(languages)))) for x in languages]
    return languages, common.stored(seen.select("affix", F.array(*likely).alias("likely")))


def _address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.", -1)
    return {
        "host": host,
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "suffix": F.element_at(labels, -1),
    }


def evidence(pages: DataFrame, languages: list[str], model: DataFrame) -> DataFrame:
    """Stored table: per distinct page its address parts, declared language, tempered text log likelihoods."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(*_key(), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    each = rows.select("a", "b", F.posexplode_outer(affixes(visible_text(F.col("html")))).alias("pos", "affix"))
    small = model.count() * len(languages) <= BROADCAST_NUMBERS
    joined = each.join(F.broadcast(model) if small else model, "affix", "left")
    sums = [F.coalesce(F.sum(F.col("likely")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(languages))]
    repeats = F.greatest(F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)), F.lit(1))
    page = joined.groupBy("a", "b").agg(
        F.count("likely").alias("n"), repeats.alias("m"), *sums
    )
    place = rows.select("a", "b", *[c.alias(n) for n, c in _address(F.col("url")).items()], declared.alias("declared")).dropDuplicates(["a", "b"])
    page = page.join(place, ["a", "b"])
    n = F.col("n") / F.col("m")
    scale = F.least(F.lit(1.0), F.lit(float(TEXT_WEIGHT)) / F.greatest(n, F.lit(1.0))) / F.col("m")
    texts = F.array(*[F.col(f"t{i}") * scale for i in range(len(languages))])
    return common.stored(page.select("a", "b", "host", "domain", "suffix", "declared", n.cast("long").alias("n_affixes"), texts.alias("texts")))


def _key() -> list[Column]:
    html = F.xxhash64(F.coalesce("html", F.lit("")))
    return [F.xxhash64("page_id", "url", html).alias("a"), F.xxhash64(html, "url", "page_id").alias("b")]


def _shares(counts: Column, parent: Column, n: int) -> Column:
    total = reduce(lambda x, y: x + y, [counts[i] for i in range(n)])
    return F.array(*[(counts[i] + F.lit(SMOOTHING) * parent[i]) / (total + F.lit(SMOOTHING)) for i in range(n)])


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per page: page_id, lang, probability, declared, n_affixes.

    A first guess from the text alone gives each page a language; grouped counts of it give how often a language comes
    with a declared one and with a suffix, and the shares of languages on each host, smoothed by those of its domain,
    which those of all pages smooth. A page's own guess is taken out of its host's counts. The answer has the
    largest sum of logarithms. Pages without text, address or declaration go by what is left; a null url is the empty host.
    Repeated rows are one page in the counts and get the same answer. Without labelled documents lang is null.
    """
    languages, model = text_model(documents)
    n = len(languages)
    if not n:
        none = F.lit(None)
        return pages.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("declared"), F.lit(0).cast("long").alias("n_affixes"))
    page = evidence(pages, languages, model)
    best = F.array_position(F.col("texts"), F.array_max("texts")).cast("int") - 1
    guessed = page.withColumn("guess", F.when(F.col("n_affixes") > 0, best))
    count = lambda i: F.sum(F.when(F.col("guess") == i, 1.0).otherwise(0.0))
    counts = F.array(*[count(i) for i in range(n)])

    overall = [x or 0.0 for x in guessed.agg(counts.alias("c")).first()["c"]]
    shares = F.lit([(x + 1.0) / (sum(overall) + n) for x in overall])
    domains = guessed.groupBy("domain").agg(counts.alias("dc")).select("domain", _shares(F.col("dc"), shares, n).alias("domain_shares"))
    hosts = guessed.groupBy("host").agg(counts.alias("host_counts"))

    def given_language(column: str) -> DataFrame:
        """log P(value of the column | language) with one pseudo page a value."""
        seen = guessed.groupBy(column).agg(counts.alias("c"))
        kinds = seen.count()
        return seen.select(column, F.array(*[F.log((F.col("c")[i] + 1.0) / F.lit(float(overall[i] + kinds))) for i in range(n)]).alias(f"{column}_log"))

    own = F.array(*[F.when(F.col("guess") == i, 1.0).otherwise(0.0) for i in range(n)])
    fused = (
        guessed.join(hosts, "host").join(domains, "domain")
        .join(given_language("declared"), "declared").join(given_language("suffix"), "suffix")
        .withColumn("others", F.zip_with("host_counts", own, lambda x, y: x - y))
        .withColumn("prior", _shares(F.col("others"), F.col("domain_shares"), n))
    )
    markup = [F.when(F.col("declared") == "", 0.0).otherwise(F.col("declared_log")[i]) for i in range(n)]
    total = F.array(*[F.col("texts")[i] + markup[i] + F.col("suffix_log")[i] + F.log(F.col("prior")[i]) for i in range(n)])
    scored = fused.withColumn("total", total).withColumn("top", F.array_max("total"))
    norm = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    answers = scored.select(
        "a", "b", F.lit(languages)[F.array_position("total", F.col("top")).cast("int") - 1].alias("lang"),
        (1 / norm).alias("probability"), F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "n_affixes",
    )
    return pages.select("page_id", *_key()).join(answers, ["a", "b"]).drop("a", "b")
