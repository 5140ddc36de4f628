"""Research memory: chunks, stored items and vector search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import fixed
from ..session import cut_lineage
from .batches import pieces
from .segments import top_k


def _window_end(text: str, begin: int, size: int) -> int:
    """End of the chunk starting at ``begin``: after the last boundary past its middle."""
    limit = begin + size
    if limit >= len(text):
        return len(text)
    for mark in fixed.CHUNK_BOUNDARIES:
        at = text.rfind(mark, begin + size // 2 + 1, limit)
        if at >= 0:
            return at + len(mark)
    return limit


def chunk_spans(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping chunks, then whatever follows the last step back."""
    back = min(overlap, size // 2)
    spans, begin = [], 0
    if not text:
        return []
    while True:
        end = _window_end(text, begin, size)
        spans.append(text[begin:end].strip())
        begin = end - back
        if end == len(text) or back == 0 or begin <= 0:
            break
    pieces = [s for s in spans if s]
    rest = text[begin:].strip() if begin > 0 else ""
    return pieces + [rest] if rest and pieces[-1:] != [rest] else pieces


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP,
           drop_tail: bool = False) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk). The boundary search is sequential inside
    one text, so it runs as a flat map over Arrow batches.

    ``drop_tail`` leaves out a last chunk that only repeats the end of the one before.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def split(batches):
        for names, bodies in pieces(batches):
            ids, pos, tot, out = [], [], [], []
            for key, body in zip(names.to_pylist(), bodies.to_pylist()):
                parts = chunk_spans(body or "", size, overlap)
                if drop_tail and len(parts) > 1 and parts[-2].endswith(parts[-1]):
                    parts = parts[:-1]
                ids += [key] * len(parts)
                pos += range(len(parts))
                tot += [len(parts)] * len(parts)
                out += parts
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, names.type), pa.array(pos, pa.int32()), pa.array(tot, pa.int32()), pa.array(out, pa.string())],
                    names=[doc_id, "chunk_index", "total_chunks", "chunk"])

    return docs.select(doc_id, text).mapInArrow(
        split, f"`{doc_id}` {id_type}, chunk_index int, total_chunks int, chunk string")


def fixed_chunks(docs: DataFrame, doc_id: str, text: str, size: int = fixed.CHUNK_CHARS,
                 overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Fixed-stride chunks of texts without boundaries, all in column expressions."""
    step = size - min(overlap, size // 2)
    n = F.length(text)
    # starts 0, step, 2*step, ... while the previous window did not reach the end
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    tail_at = last * step + F.least(n - last * step, F.lit(size)) - min(overlap, size // 2)
    tail = F.substring(F.col(text), tail_at + 1, F.lit(size))
    with_tail = F.when((tail_at > 0) & (tail_at < n) & (tail != F.element_at(spans, -1)), F.concat(spans, F.array(tail))).otherwise(spans)
    return docs.filter(n > 0).select(doc_id, F.posexplode(with_tail).alias("chunk_index", "chunk"))


def _hex_id(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*cols), 256), 1, 16))


def _items(df: DataFrame, item_id: Column, kind: str, text: Column, stored_at: Column, **meta: Column) -> DataFrame:
    fields = ["url", "title", "topic", "domain", "sources", "query"]
    return df.select(
        item_id.alias("id"), F.lit(kind).alias("type"), text.alias("text"),
        *[meta.get(f, F.lit(None)).cast("string").alias(f) for f in fields],
        meta.get("relevance", F.lit(None)).cast("double").alias("relevance"),
        F.coalesce(F.col("report_id"), F.lit("")).alias("report_id"), stored_at.alias("stored_at"))


def finding_items(findings: DataFrame, stored_at: Column) -> DataFrame:
    """Findings ``(report_id, claim, topic, confidence, source_urls)`` with their text caps."""
    f = findings.filter(F.coalesce("claim", F.lit("")) != "")
    return _items(f, _hex_id("finding_", F.col("claim")), "finding", F.substring("claim", 1, 2000), stored_at,
                  topic=F.coalesce("topic", F.lit("")), relevance=F.coalesce("confidence", F.lit(0.5)),
                  sources=F.to_json(F.slice("source_urls", 1, 5)))


def citation_items(citations: DataFrame, stored_at: Column) -> DataFrame:
    c = citations.filter(F.coalesce("quote", F.lit("")) != "")
    return _items(c, _hex_id("cite_", F.col("url"), F.col("quote")), "citation", F.substring("quote", 1, 2000), stored_at,
                  url=F.col("url"), title=F.substring("title", 1, 200), domain=F.col("domain"),
                  relevance=F.coalesce("relevance", F.lit(0.5)))


def snippet_items(chunk_rows: DataFrame, stored_at: Column) -> DataFrame:
    """Chunks ``(report_id, url, title, topic, chunk_index, chunk)`` as stored snippets."""
    item = F.concat(_hex_id("snippet_", F.col("url")), F.lit("_"), F.col("chunk_index").cast("string"))
    return _items(chunk_rows, item, "snippet", F.col("chunk"), stored_at, url=F.col("url"),
                  title=F.substring("title", 1, 200), topic=F.col("topic"))


def summary_items(reports: DataFrame, stored_at: Column) -> DataFrame:
    """Report summaries ``(report_id, query, summary, findings, citations, confidence)``."""
    r = reports.filter(F.coalesce("summary", F.lit("")) != "")
    body = F.concat(
        F.lit("Research: "), "query", F.lit("\n\nSummary: "), "summary", F.lit("\n\nFindings: "), F.col("findings").cast("string"),
        F.lit("\nCitations: "), F.col("citations").cast("string"), F.lit("\nConfidence: "), F.col("confidence").cast("string"), F.lit("\n"))
    return _items(r, F.concat(F.lit("report_summary_"), "report_id"), "report_summary", F.substring(body, 1, 4000),
                  stored_at, query=F.substring("query", 1, 200), relevance=F.col("confidence"))


def store(existing: DataFrame | None, *parts: DataFrame) -> DataFrame:
    """Items of all parts, first version of an id kept."""
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    new = top_k(new, ["id"], [F.col("stored_at"), F.col("type"), F.col("report_id"), F.col("text")], 1)
    return new if existing is None else existing.unionByName(new.join(existing.select("id"), "id", "left_anti"))


def delete_report(items: DataFrame, report_ids: DataFrame) -> DataFrame:
    return items.join(report_ids.select("report_id").distinct(), "report_id", "left_anti")


def reports(items: DataFrame) -> DataFrame:
    return items.filter("type = 'report_summary'").select(
        "id", "query", "report_id", F.col("relevance").alias("confidence"), "stored_at").orderBy(F.col("stored_at").desc(), "id")


def count(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"))


# ---- vector search -----------------------------------------------------------------------

def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str = "embedding",
            n: int = 5, min_relevance: float | None = None, where: Column | None = None,
            batch_queries: int = 4096) -> DataFrame:
    """Exact cosine top-n per query: (query_id, item_id, relevance, rank).

    The query set is cut into batches of at most ``batch_queries`` vectors; a batch is small
    enough to ship with the task. Every task multiplies its item vectors with the batch and
    keeps only its best n per query, so a scan emits queries x n rows per partition, never
    all pairs. ``min_relevance`` is applied after the top-n.
    """
    if where is not None:
        items = items.filter(where)
    spark = items.sparkSession
    source = items.select(item_id, vector)
    id_type, q_type = items.schema[item_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"`{query_id}` {q_type}, `{item_id}` {id_type}, similarity double"
    parts, last = [], None
    while True:
        # next batch of queries in id order: a bounded read, whatever the query set holds
        page = queries.select(query_id, vector)
        if last is not None:
            page = page.filter(F.col(query_id) > F.lit(last))
        page = page.orderBy(query_id).limit(batch_queries).collect()
        if not page:
            break
        last = page[-1][0]
        ids = [r[0] for r in page]
        shared = spark.sparkContext.broadcast(_unit(np.array([r[1] for r in page], dtype=np.float64)))

        def scan(batches, ids=ids, shared=shared):
            q = shared.value
            best: list[list] = [[] for _ in ids]
            for pdf in batches:
                if pdf.empty:
                    continue
                sims = q @ _unit(np.stack(pdf[vector].to_numpy()).astype(np.float64)).T
                names = pdf[item_id].tolist()
                top = min(n, sims.shape[1])
                for row, heap in enumerate(best):
                    bound = np.partition(sims[row], -top)[-top]
                    near = np.nonzero(sims[row] >= bound)[0]
                    best[row] = heapq.nsmallest(n, heap + [(-sims[row, i], names[i]) for i in near])
            out = [(ids[i], name, -s) for i, heap in enumerate(best) for s, name in heap]
            if out:
                yield pd.DataFrame(out, columns=[query_id, item_id, "similarity"])

        parts.append(source.mapInPandas(scan, schema))
        if len(page) < batch_queries:
            break
    if not parts:
        return spark.createDataFrame([], f"`{query_id}` {q_type}, `{item_id}` {id_type}, relevance double, rank int")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    best = top_k(merged, [query_id], [F.col("similarity").desc(), F.col(item_id)], n, name="rank")
    out = best.select(query_id, item_id, F.greatest(F.lit(0.0), F.col("similarity")).alias("relevance"), "rank")
    return out.filter(F.col("relevance") >= min_relevance) if min_relevance is not None else out


def related_topics(neighbours: DataFrame, items: DataFrame, item_id: str, query_id: str, topics: DataFrame,
                   topic: str = "topic") -> DataFrame:
    """Sorted topics of the nearest findings other than the asked topic (n per query at most).

    ``topics(query_id, asked)`` names the topic each query stands for.
    """
    near = neighbours.join(items.select(item_id, F.col(topic).cast("string").alias("_t")), item_id).join(
        topics.select(query_id, "asked"), query_id)
    other = near.filter((F.coalesce("_t", F.lit("")) != "") & (F.lower("_t") != F.lower("asked")))
    return other.groupBy(query_id).agg(F.array_sort(F.collect_set("_t")).alias("topics"))


def _best(sims: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values of every row, largest first, ties to the smaller place, NaN last."""
    key = np.where(np.isnan(sims), np.inf, -sims)
    bound = np.partition(key, top - 1, axis=1)[:, top - 1:top]
    rows, cols = np.nonzero(key <= bound)
    order = np.lexsort((cols, key[rows, cols], rows))
    first = np.searchsorted(rows, np.arange(len(sims)))
    return cols[order][np.arange(len(order)) - first[rows] < top].reshape(len(sims), top)


def cell_centres(items: DataFrame, item_id: str, vector: str = "embedding", cells: int | None = None, sample_rows: int = 20_000, seed: int = 42) -> np.ndarray:
    """Unit centres of the coarse cells: k-means on a hash sample of about ``sample_rows`` vectors.

    The number of cells defaults to half the square root of the number of vectors, 4096 at most, so centres stay a few megabytes.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    filled = items.filter(F.col(vector).isNotNull() & (F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x) > 0))
    n = filled.count()
    if not n:
        return np.zeros((0, 0))
    k = max(2, min(cells or min(4096, int(n ** 0.5 / 2)), n))
    part = filled.filter(F.pmod(F.xxhash64(item_id), F.lit(max(1, n // sample_rows))) == 0)
    points = part.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    fitted = KMeans(k=k, seed=seed, initMode="random", maxIter=10, distanceMeasure="cosine").fit(points)
    return _unit(np.array(fitted.clusterCenters(), dtype=np.float64))


def nearest_by_cells(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str = "embedding", n: int = 5, probes: int = 8,
                     min_relevance: float | None = None, where: Column | None = None, match: tuple[str, ...] = (), centres: np.ndarray | None = None, block: int = 4096, wide_block: int = 16384) -> DataFrame:
    """Cosine top-n for a whole table of queries: (query_id, item_id, relevance, rank), ties to the smaller item.

    Items lie in the cell of their nearest centre; a query looks into its ``probes`` nearest cells (all, if there are no
    more: then the answer is exact) and ranks what it finds there by exact cosine. Only items that meet ``where`` and agree
    with the query in the ``match`` columns count. Items and queries of a cell meet in blocks of about ``block`` rows each, so neither
    a hot cell nor many queries fill one task, and a block hands on n rows a query. A query that probes all cells would be copied
    into each of them: there, neighbouring cells share a block of about ``wide_block`` rows, and a query goes once to a block. Only
    the centres pass through the driver.
    """
    items = items.filter(where) if where is not None else items
    centres = cell_centres(items, item_id, vector) if centres is None else centres
    spark = items.sparkSession
    id_type, q_type = items.schema[item_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    if not len(centres):
        return spark.createDataFrame([], f"`{query_id}` {q_type}, `{item_id}` {id_type}, relevance double, rank int")
    shared = spark.sparkContext.broadcast(centres)

    def picked(df: DataFrame, ident: str) -> DataFrame:
        kind = "array<float>" if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"
        return df.select(F.col(ident).alias("_id"), *[F.col(m).alias(f"_m{i}") for i, m in enumerate(match)], F.col(vector).cast(kind).alias("_v"))

    def in_cells(picked: DataFrame, take: int) -> DataFrame:
        def assign(batches):
            for pdf in batches:
                pdf = pdf[pdf["_v"].notna()]
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at:at + 1024]
                    sims = _unit(np.stack(part["_v"].to_numpy()).astype(np.float64)) @ shared.value.T
                    near = np.argmax(sims, axis=1)[:, None] if take == 1 else np.argsort(-sims, axis=1, kind="stable")[:, :take]
                    yield part.assign(_cells=list(near.astype(np.int32)))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
        return picked.mapInPandas(assign, f"{kinds}, _cells array<int>").withColumn("_cell", F.explode("_cells")).drop("_cells")

    own = [f"_m{i}" for i in range(len(match))]
    cell = [*own, "_cell"]
    stored = cut_lineage(in_cells(picked(items, item_id), 1))
    dealt = lambda name: F.pmod(F.xxhash64("_id"), F.col(name)).cast("int")
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    if probes < len(centres):
        asked = cut_lineage(in_cells(picked(queries, query_id), probes))
        sizes = stored.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
        waiting = asked.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("_groups"))
        plan = sizes.join(waiting, cell)
        left = asked.join(plan, cell).withColumn("_group", dealt("_groups")).withColumn("_block", spread("_blocks")).drop("_blocks", "_groups")
        right = stored.join(plan, cell).withColumn("_block", dealt("_blocks")).withColumn("_group", spread("_groups")).drop("_blocks", "_groups")
        by = [*cell, "_block", "_group"]
    else:
        # neighbouring cells share a block, a cell that fills more than one has blocks of its own; every query visits every block once
        one = own or ["_one"]
        whole = lambda df: df if own else df.withColumn("_one", F.lit(0))
        asked, stored = whole(cut_lineage(picked(queries, query_id).filter(F.col("_v").isNotNull()))), whole(stored)
        before = W.partitionBy(*one).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        cells = stored.groupBy(*one, "_cell").agg(F.count("*").alias("_n")).select(
            *one, "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / wide_block).alias("_run"), F.ceil(F.col("_n") / wide_block).cast("int").alias("_blocks"))
        named = lambda part: F.when(F.col("_blocks") == 1, F.struct(F.col("_run").alias("run"), F.lit(0).alias("part"))).otherwise(F.struct((-1 - F.col("_cell")).cast("long").alias("run"), part.alias("part")))
        blocks = cells.withColumn("_part", spread("_blocks")).groupBy(*one).agg(F.collect_set(named(F.col("_part"))).alias("_all"))
        groups = asked.groupBy(*one).agg(F.ceil(F.count("*") / wide_block).cast("int").alias("_groups"))
        visits = blocks.join(groups, one)
        left = asked.join(visits, one).withColumn("_group", dealt("_groups")).withColumn("_block", F.explode("_all")).drop("_all", "_groups")
        right = stored.join(cells.join(groups, one), [*one, "_cell"]).withColumn("_block", named(dealt("_blocks"))).withColumn("_group", spread("_groups")).drop("_run", "_blocks", "_groups", "_cell")
        by = [*one, "_block", "_group"]

    def rank(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({query_id: [], item_id: [], "similarity": []})
        i = i.sort_values("_id", kind="stable")
        names, against = i["_id"].to_numpy(), _unit(np.stack(i["_v"].to_numpy()).astype(np.float64)).T
        top, found, scores = min(n, len(i)), [], []
        for at in range(0, len(q), 128):
            sims = _unit(np.stack(q["_v"].iloc[at:at + 128].to_numpy()).astype(np.float64)) @ against
            order = _best(sims, top)
            found.append(names[order].ravel())
            scores.append(np.take_along_axis(sims, order, axis=1).ravel())
        return pd.DataFrame({query_id: np.repeat(q["_id"].to_numpy(), top), item_id: np.concatenate(found), "similarity": np.concatenate(scores)})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(rank, f"`{query_id}` {q_type}, `{item_id}` {id_type}, similarity double")
    best = top_k(found, [query_id], [F.col("similarity").desc(), F.col(item_id)], n, name="rank")
    out = best.select(query_id, item_id, F.greatest(F.lit(0.0), F.col("similarity")).alias("relevance"), "rank")
    return out.filter(F.col("relevance") >= min_relevance) if min_relevance is not None else out
