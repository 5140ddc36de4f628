"""Research evidence: scoring, citations, findings and reports as tables keyed by report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as X, urls as U
from .segments import top_k

CLAIMS_SCHEMA = (
    "claims array<struct<claim:string,topic:string,needs_verification:boolean>>, follow_up_questions array<string>"
)


def sub_questions(topics: DataFrame, topic="topic") -> DataFrame:
    """Five questions and four search queries per topic."""
    t = F.col(topic)
    forms = [
        ("question", 1, F.concat(F.lit("What is "), t, F.lit("?"))),
        ("question", 2, F.concat(F.lit("History of "), t)),
        ("question", 3, F.concat(F.lit("Key facts about "), t)),
        ("question", 4, F.concat(F.lit("Pros and cons of "), t)),
        ("question", 5, F.concat(F.lit("How does "), t, F.lit(" work?"))),
        ("query", 1, t),
        ("query", 2, F.concat(t, F.lit(" definition"))),
        ("query", 3, F.concat(t, F.lit(" explained"))),
        ("query", 4, F.concat(t, F.lit(" guide"))),
    ]
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("pos"), c.alias("text")) for k, i, c in forms])
    return topics.select(t.alias("topic"), F.explode(items).alias("x")).select("topic", "x.kind", "x.pos", "x.text")


def keywords(topics: DataFrame, topic="topic") -> DataFrame:
    return topics.select(F.col(topic).alias("topic"), F.posexplode(X.long_words(topic)).alias("pos", "text"))


def citations(candidates: DataFrame, question="question", content="content", url="url", title="title",
              published: str | None = None) -> DataFrame:
    """Citation per candidate (question, page) pair: quote, relevance, domain.

    ``candidates`` already pairs each question with the pages found for it, so the work is
    one row per pair and needs no join here.
    """
    keep = [c for c in candidates.columns if c not in (content, title)]
    return candidates.select(
        *keep, F.coalesce(title, url).alias("title"), U.domain(url).alias("domain"),
        X.relevant_quote(content, question).alias("quote"), X.relevance(content, question).alias("relevance"),
        (F.coalesce(F.col(published), F.lit("")) if published else F.lit("")).alias("timestamp"),
    )


def best_sources(scored: DataFrame, question="question", score="relevance", tie="url", k: int = 5) -> DataFrame:
    return top_k(scored, [question], [F.col(score).desc(), F.col(tie)], k, name="rank")


def findings_from_answers(answers: DataFrame, answer="answer") -> DataFrame:
    """Claims of each JSON answer with their starting confidence."""
    keep = [c for c in answers.columns if c != answer]
    rows = answers.select(*keep, F.posexplode(F.from_json(answer, CLAIMS_SCHEMA)["claims"]).alias("pos", "c"))
    doubt = F.coalesce("c.needs_verification", F.lit(False))
    return rows.select(
        *keep, "pos", F.coalesce("c.topic", F.lit("general")).alias("topic"), F.coalesce("c.claim", F.lit("")).alias("claim"),
        F.when(doubt, 0.4).otherwise(0.7).alias("confidence"), doubt.alias("needs_verification"))


def facts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Highest confidence seen per claim."""
    return findings.groupBy(*keys, "claim").agg(F.max("confidence").alias("confidence"))


def sources_per_domain(citation_rows: DataFrame, keys: list[str]) -> DataFrame:
    return citation_rows.groupBy(*keys, "domain").agg(F.count("*").alias("citations"))


def average_confidence(fact_rows: DataFrame, keys: list[str]) -> DataFrame:
    return fact_rows.groupBy(*keys).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def ordered_findings(findings: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Findings with the order of their topic: topics follow their best finding."""
    first = findings.groupBy(*keys, "topic").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col(seq).alias("s"))).alias("topic_order"))
    return findings.join(first, [*keys, "topic"])


def topic_groups(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "topic").agg(
        F.count("*").alias("findings"), F.max("confidence").alias("best"), F.avg("confidence").alias("mean"))


def knowledge_graph(findings: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """(topic, word) rows: long words among the first five of each claim, topic excluded.

    Kept as rows in (confidence, seq, pos) order, so a topic with very many claims is never
    one array.
    """
    first5 = F.slice(F.filter(F.split("claim", r"(?U)\s+"), lambda w: w != ""), 1, 5)
    return (
        findings.select(*keys, "topic", "confidence", seq, F.posexplode(first5).alias("pos", "w"))
        .filter((F.length("w") > 4) & (F.lower("w") != F.lower("topic")))
        .select(*keys, "topic", F.lower("w").alias("word"), "confidence", seq, "pos")
    )


def confidence_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if(F.col("confidence") >= 0.7).alias("high"),
        F.count("*").alias("total"))


_GRAM_SIZES = [1, 2, 4, 8, 16, 32]


def _substring_pairs(small: DataFrame, big: DataFrame):
    """Both sides of the test "``s`` of (report, s) occurs inside ``b`` of (report, b)".

    Nothing is paired with everything: a string is filed under its first characters (the
    largest power of two up to 32 it has), a container is cut into all its pieces of the
    lengths in use, and only equal pieces meet. Semi joins on the condition stop at the
    first hit and never emit pairs.
    """
    n = F.length("s")
    size = F.lit(_GRAM_SIZES[0])
    for k in _GRAM_SIZES[1:]:
        size = F.when(n >= k, F.lit(k)).otherwise(size)
    s = small.select("report_id", "s").distinct().filter(n > 0).withColumn("_k", size)
    s = s.withColumn("_g", F.substring(F.col("s"), F.lit(1), F.col("_k")))
    used = s.select("report_id", "_k").distinct()
    b = big.select("report_id", "b").distinct().join(used, "report_id").filter(F.length("b") >= F.col("_k"))
    starts = F.sequence(F.lit(1), F.length("b") - F.col("_k") + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("b"), i, F.col("_k"))))
    b = b.select("report_id", "_k", "b", F.explode(grams).alias("_g"))
    cond = (
        (s["report_id"] == b["report_id"]) & (s["_k"] == b["_k"]) & (s["_g"] == b["_g"]) & b["b"].contains(s["s"])
    )
    return s, b, cond


def _contained(small: DataFrame, big: DataFrame) -> DataFrame:
    s, b, cond = _substring_pairs(small, big)
    return s.join(b, cond, "left_semi").select("report_id", "s")


def _containers(small: DataFrame, big: DataFrame) -> DataFrame:
    s, b, cond = _substring_pairs(small, big)
    return b.join(s, cond, "left_semi").select("report_id", "b").distinct()


def unanswered(questions: DataFrame, findings: DataFrame, first: int | None = 10) -> DataFrame:
    """Pending questions ``(report_id, question, seq)`` that no claim contains or is part of.

    An empty claim is part of everything, as in any substring test.
    """
    q = questions.withColumn("_q", F.lower("question"))
    claims = findings.select("report_id", F.lower("claim").alias("claim")).distinct()
    inside = _contained(q.select("report_id", F.col("_q").alias("s")), claims.select("report_id", F.col("claim").alias("b")))
    holding = _containers(claims.select("report_id", F.col("claim").alias("s")), q.select("report_id", F.col("_q").alias("b")))
    empty = claims.filter("claim = ''").select("report_id").distinct()
    out = (
        q.join(inside.select("report_id", F.col("s").alias("_q")).distinct(), ["report_id", "_q"], "left_anti")
        .join(holding.select("report_id", F.col("b").alias("_q")), ["report_id", "_q"], "left_anti")
        .join(empty, "report_id", "left_anti").drop("_q")
    )
    return top_k(out, ["report_id"], [F.col("seq")], first) if first else out


def report_confidence(sources: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Source count, mean of the five best relevances, contradiction penalty, clamped to [0, 1]."""
    n = sources.groupBy("report_id").agg(F.count("*").alias("n"))
    top5 = top_k(sources, ["report_id"], [F.col("relevance").desc()], 5).groupBy("report_id").agg(F.avg("relevance").alias("rel"))
    c = contradictions.groupBy("report_id").agg(F.count("*").alias("c"))
    value = (
        F.least(F.col("n") / 10.0, F.lit(1.0)) * 0.4 + F.col("rel") * 0.3 + 0.3
        - F.least(F.coalesce("c", F.lit(0)) * 0.1, F.lit(0.3))
    )
    return n.join(top5, "report_id").join(c, "report_id", "left").select(
        "report_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"))


def contradiction_warnings(contradictions: DataFrame, first: int = 3) -> DataFrame:
    rows = top_k(contradictions, ["report_id"], [F.col("seq")], first)
    return rows.select("report_id", "seq", F.concat(
        F.lit("Contradiction detected: '"), "claim_a", F.lit("' vs '"), "claim_b", F.lit("'")).alias("warning"))


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str, name: str) -> DataFrame:
    """Ordered concatenation of a bounded number of rows per key."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(items.alias("_i")).select(*keys, F.array_join(F.transform("_i", lambda x: x["_t"]), sep).alias(name))


def summaries(reports: DataFrame, findings: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """Summary sentence per report ``(report_id, query)`` with its five best claims."""
    best = top_k(findings, ["report_id"], [F.col("confidence").desc(), F.col("seq")], 5)
    best = best.withColumn("_c", -F.col("confidence")).withColumn("_t", F.concat(F.lit("- "), "claim"))
    claims = _joined(best, ["report_id"], ["_c", "seq"], "_t", " ", "claims")
    nf = findings.groupBy("report_id").agg(F.count("*").alias("nf"))
    nc = citation_rows.groupBy("report_id").agg(F.count("*").alias("nc"))
    j = reports.join(claims, "report_id", "left").join(nf, "report_id", "left").join(nc, "report_id", "left")
    some = F.concat(
        F.lit("Research on '"), "query", F.lit("' consulted "), F.coalesce("nc", F.lit(0)).cast("string"),
        F.lit(" sources and produced "), F.col("nf").cast("string"), F.lit(" findings. Top conclusions: "),
        F.substring("claims", 1, 300), F.lit("..."))
    none = F.concat(F.lit("Research on '"), "query", F.lit("' did not yield sufficient information to form conclusions."))
    return j.select("report_id", F.when(F.col("nf").isNull(), none).otherwise(some).alias("summary"))


def synthesis_context(sources: DataFrame, k: int = 10) -> DataFrame:
    """Title, URL and summary of the ten best sources per report."""
    best = top_k(sources, ["report_id"], [F.col("relevance").desc(), F.col("url")], k)
    brief = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.substring("raw_content", 1, 200))
    best = best.withColumn("_t", F.concat(
        F.lit("## Source: "), "title", F.lit("\nURL: "), "url", F.lit("\nSummary: "), brief, F.lit("\n")))
    best = best.withColumn("_r", -F.col("relevance"))
    return _joined(best, ["report_id"], ["_r", "url"], "_t", "\n\n", "context")


def _title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def report_bodies(reports: DataFrame, findings: DataFrame, citation_rows: DataFrame, as_of: Column,
                  length: str = "standard") -> DataFrame:
    """Markdown body per report, cut to its target number of words.

    Every line holds at least one word, so only the first 1.5 x target lines of a report can
    appear; the number of all words is an aggregate. A report with any number of findings is
    therefore assembled from a bounded number of rows.
    """
    target = fixed.REPORT_WORDS.get(length, fixed.REPORT_WORDS["standard"])
    keep = int(target * 1.5) + 1
    nf = findings.groupBy("report_id").agg(F.count("*").alias("nf"), F.count_if(F.col("confidence") >= 0.7).alias("hi"))
    nc = citation_rows.groupBy("report_id").agg(F.count("*").alias("nc"))
    head = reports.join(nf, "report_id", "left").join(nc, "report_id", "left").na.fill(0, ["nf", "hi", "nc"])
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("s"))

    def lines(df, section, text, topic_order=zero, order=zero, part=0):
        return df.select("report_id", F.lit(section).alias("a"), topic_order.alias("b"), order.alias("d"), F.lit(part).alias("e"), text.alias("line"))

    intro = lines(head, 0, F.concat(
        F.lit("# Research Report: "), "query", F.lit("\n\n*Generated: "), F.date_format(as_of, "yyyy-MM-dd HH:mm"),
        F.lit(" UTC*\n## Executive Summary\nThis research examined '"), "query", F.lit("' across "), F.col("nc").cast("string"),
        F.lit(" sources and identified "), F.col("nf").cast("string"), F.lit(" distinct findings. "),
        F.col("hi").cast("string"), F.lit(" findings are supported by high-confidence evidence.\n\n## Findings by Topic\n")))
    f = ordered_findings(findings, ["report_id"])
    f = f.withColumn("topic_order", F.struct(F.col("topic_order.c").alias("c"), F.col("topic_order.s").cast("long").alias("s")))
    mine = F.struct((-F.col("confidence")).alias("c"), F.col("seq").cast("long").alias("s"))
    low = F.struct(F.lit(float("-inf")).alias("c"), F.lit(0).cast("long").alias("s"))
    high = F.struct(F.lit(float("inf")).alias("c"), F.lit(0).cast("long").alias("s"))
    topics = f.select("report_id", "topic", "topic_order").distinct()
    parts = [
        intro,
        lines(topics, 1, F.concat(F.lit("### "), _title_case(F.col("topic")), F.lit("\n")), F.col("topic_order"), low),
        lines(f, 1, F.concat(F.lit("**["), X.confidence_label("confidence"), F.lit("]** "), "claim", F.lit("\n")), F.col("topic_order"), mine),
        lines(topics, 1, F.lit("\n"), F.col("topic_order"), high),
        lines(head, 2, F.lit("## Sources\n")),
    ]
    if "domains" in findings.columns:
        cited = f.filter(F.size("domains") > 0)
        parts.append(lines(cited, 1, F.concat(F.lit("  *Sources: "), F.array_join(F.slice("domains", 1, 2), ", "), F.lit("*\n")),
                           F.col("topic_order"), mine, 1))
    cites = top_k(citation_rows, ["report_id"], [F.col("seq")], 20)
    seq = F.struct(F.lit(0.0).alias("c"), F.col("seq").cast("long").alias("s"))
    quote = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit('  > "'), F.substring("quote", 1, 200), F.lit('..."\n'))).otherwise("")
    parts.append(lines(cites, 3, F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") ("), "domain", F.lit(")\n"), quote), order=seq))
    doubtful = findings.filter(F.col("confidence") < 0.5)
    parts.append(lines(doubtful.select("report_id").distinct(), 4, F.lit("\n## Areas Requiring Verification\n")))
    parts.append(lines(top_k(doubtful, ["report_id"], [F.col("confidence").desc(), F.col("seq")], 5), 5, F.concat(
        F.lit("- **"), "claim", F.lit("** (confidence: "), F.format_string("%.0f", F.col("confidence") * 100), F.lit("%)\n")), order=mine))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    count = F.size(F.filter(F.split("line", r"(?U)\s+"), lambda w: w != ""))
    rows = rows.withColumn("_n", count)
    total = rows.groupBy("report_id").agg(F.sum("_n").alias("words"))
    # blank separator lines hold no word: allow one per topic line
    first = top_k(rows, ["report_id"], [F.col(c) for c in ("a", "b", "d", "e", "line")], 2 * keep)
    body = _joined(first, ["report_id"], ["a", "b", "d", "e"], "line", "", "body")
    all_words = F.filter(F.split("body", r"(?U)\s+"), lambda w: w != "")
    return body.join(total, "report_id").select(
        "report_id", "words",
        F.when(F.col("words") > target * 1.5, F.array_join(F.slice(all_words, 1, target), " ")).otherwise(F.col("body")).alias("body"))
