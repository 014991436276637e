"""From texts to chunks and sections: folds inside a row and windows inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences

SIZE, OVERLAP = 450, 120


def prepared(text: Column, longest: int = 400) -> Column:
    """Lines stripped and joined by spaces; a long line with bullets is first cut after full stops."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    cut = lambda x: F.filter(F.transform(F.split(x, r"(?<=\.)\s+(?=[A-Z])"), lambda x: F.trim(x)), lambda y: F.length(y) > 0)
    bullets = lambda x: (F.length(x) > longest) & (F.contains(x, F.lit("* ")) | F.contains(x, F.lit("- ")))
    return F.array_join(F.flatten(F.transform(lines, lambda x: F.when(bullets(x), cut(x)).otherwise(F.array(x)))), " ")


def packed_sentences(parts: Column, size: Column | int = SIZE, overlap: Column | int = OVERLAP) -> Column:
    """Array of chunks: sentences go together until the next would pass size characters (spaces not counted);
    each chunk begins with the longest run of whole last sentences of the one before within overlap."""
    size, overlap = (F.lit(x) if isinstance(x, int) else x for x in (size, overlap))
    strings, empty = "array<string>", F.array().cast("array<string>")

    def tail(chunk: Column) -> Column:
        state = F.struct(empty.alias("kept"), F.lit(0).alias("length"), F.lit(True).alias("open"))

        def back(s: Column, x: Column) -> Column:
            fits = s["open"] & (s["length"] + F.length(x) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(fits, s["length"] + F.length(x)).otherwise(s["length"]).alias("length"), fits.alias("open"))

        return F.aggregate(F.reverse(chunk), state, back)

    def step(s: Column, x: Column) -> Column:
        flush = (s["length"] + F.length(x) > size) & (F.size(s["now"]) > 0)
        kept = tail(s["now"])
        return F.struct(
            F.when(flush, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(flush, kept["kept"]).otherwise(s["now"]), F.array(x)).alias("now"),
            (F.when(flush, kept["length"]).otherwise(s["length"]) + F.length(x)).alias("length"),
        )

    start = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("length"))
    last = lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]).cast(strings)
    return F.aggregate(parts, start, step, last)


def chunked(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", size: Column | int = SIZE, overlap: Column | int = OVERLAP) -> DataFrame:
    """id, chunk_index, total_chunks, content. One pass, row by row; a text without sentences has no chunk."""
    chunks = packed_sentences(sentences(prepared(F.col(text))), size, overlap)
    return docs.select(F.col(id_), chunks.alias("chunks")).select(id_, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "content")).select(id_, "chunk_index", "total_chunks", "content")


def sections(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", header: str = r"^(#{1,6}\s+\S.*|\d+(\.\d+)*\s+[A-Z].*|[A-Z][A-Z \-]{3,})$") -> DataFrame:
    """id, section, title, n_lines, n_chars: lines between headers; sections without content are left out."""
    lines = docs.select(id_, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.withColumn("head", F.col("line").rlike(header).cast("int"))
    lines = lines.withColumn("section", F.sum("head").over(W.partitionBy(id_).orderBy("pos")))
    body = (F.col("head") == 0) & (F.length("line") > 0)
    out = lines.groupBy(id_, "section").agg(F.max(F.when(F.col("head") == 1, F.col("line"))).alias("title"), F.count_if(body).alias("n_lines"), F.sum(F.when(body, F.length("line")).otherwise(0)).alias("n_chars"))
    return out.where("n_lines > 0")


def windows(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """id, window, content: fixed windows of characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(size - overlap))
    return docs.where(F.length(text) > 0).select(id_, F.col(text).alias("_text"), F.posexplode(starts).alias("window", "at")).select(id_, "window", F.substring(F.col("_text"), F.col("at") + 1, F.lit(size)).alias("content"))


def sentence_windows(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """id, window, start, end, content: windows that end after the last boundary of the first kind found past half
    of the size (full stop and space, full stop and line end, question mark, exclamation and line end); the next
    one starts overlap characters before. Where a window ends depends on the one before, so rows pass through
    Arrow in batches."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for i, t in zip(frame[id_], frame[text], strict=True):
                start, n, k = 0, len(t or ""), 0
                while start < n:
                    end = min(start + size, n)
                    if end < n:
                        found = ((t.rfind(b, start, end), len(b)) for b in (". ", ".\n", "? ", "!\n"))
                        end = next((at + m for at, m in found if at - start > size * 0.5), end)
                    if part := t[start:end].strip():
                        out.append((i, k, start, end, part))
                        k += 1
                    start = end - overlap if end < n else n
            yield pd.DataFrame(out, columns=[id_, "window", "start", "end", "content"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(id_, text).mapInPandas(run, f"`{id_}` {kind}, window int, start int, end int, content string")


def paragraph_scores(docs: DataFrame, terms: tuple[str, ...], *, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, pos, paragraph, score, before, after: distinct terms in each paragraph, with the paragraphs around it.
    Blank lines part paragraphs; a line end alone does not."""
    parts = docs.select(id_, F.posexplode(F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)).alias("pos", "paragraph"))
    score = sum((F.when(F.contains(F.lower("paragraph"), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    order = W.partitionBy(id_).orderBy("pos")
    return parts.select(id_, "pos", "paragraph", score.alias("score"), F.lag("paragraph").over(order).alias("before"), F.lead("paragraph").over(order).alias("after"))


def topic_excerpt(text: Column, terms: tuple[str, ...], most: int = 10, chars: int = 5000) -> Column:
    """The paragraphs that name most terms, each with the ones around it, up to `most`, in that order; a paragraph next
    to one that is taken already is passed over. Joined by a rule, cut to `chars` with three dots. Empty without a hit.

    A greedy choice, so a fold over the paragraphs with a hit; what it carries is the places taken."""
    parts = F.split(text, r"\n\s*\n", -1)
    score = lambda p: sum((F.when(F.contains(F.lower(p), F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    hits = F.array_sort(F.filter(F.transform(parts, lambda p, i: F.struct((-score(p)).alias("s"), i.alias("i"))), lambda x: x["s"] < 0))
    free = lambda kept, i: (F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k - i) <= 1)
    kept = F.aggregate(hits, F.array().cast("array<int>"), lambda kept, x: F.when(free(kept, x["i"]), F.concat(kept, F.array(x["i"]))).otherwise(kept))
    whole = lambda i: F.array_join(F.slice(parts, F.greatest(i, F.lit(1)), F.least(F.size(parts), i + 2) - F.greatest(i - 1, F.lit(0))), "\n\n")
    out = F.array_join(F.transform(kept, whole), "\n\n---\n\n")
    return F.when(F.length(out) > chars, F.concat(F.substring(out, 1, chars), F.lit("..."))).otherwise(out)
