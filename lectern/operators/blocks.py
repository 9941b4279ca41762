"""Layout blocks to segments: texts, headers, offsets, neighbours and images.

A block has ``doc_id, block_idx, type, text, text_level, bbox, page_idx, img_path,
image_caption, image_footnote, table_caption, table_footnote, table_body,
llm_description``. Order in a document is ``block_idx``; windows are by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

SPECIAL = ("image", "table", "equation")
BLOCK_SCHEMA = (
    "doc_id long, block_idx int, type string, text string, text_level int, bbox array<int>, page_idx int, img_path string, "
    "image_caption array<string>, image_footnote array<string>, table_caption array<string>, table_footnote array<string>, "
    "table_body string, llm_description string"
)


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("block_idx")


def kept(blocks: DataFrame) -> DataFrame:
    """Without discarded blocks, numbered anew; blocks without a type stay."""
    left = blocks.where(~F.col("type").eqNullSafe("discarded"))
    return left.withColumn("block_idx", (F.row_number().over(in_doc()) - 1).cast("int"))


def caption() -> Column:
    of_table = F.coalesce(F.nullif(T.join_list("table_caption"), F.lit("")), T.join_list("table_footnote"))
    return T.normalize_text(F.when(F.col("type") == "image", T.join_list("image_caption")).when(F.col("type") == "table", of_table).otherwise(""))


def block_text(use_description: bool = True, prefix: bool = True) -> Column:
    """A block's text for the layout chunker; captions are joined flat."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    image = T.join_list(F.array(T.join_list("image_caption"), T.join_list("image_footnote")))
    table = T.join_list(F.array(T.join_list("table_caption"), T.join_list("table_footnote"), T.strip_html("table_body")))
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, T.join_list("image_caption"), T.join_list("table_caption"), F.col("table_body"))], F.lit(""))
    out = F.when(kind.isin("text", "equation"), text).when(kind == "image", T.apply_prefix(image, kind, prefix)).when(kind == "table", T.apply_prefix(table, kind, prefix)).otherwise(first)
    if not use_description:
        return out
    described = kind.isin(*SPECIAL) & (F.coalesce("llm_description", F.lit("")) != "")
    return F.when(described, T.apply_prefix(F.col("llm_description"), kind, prefix)).otherwise(out)


def sticky_header(levels: tuple[int, ...] = (1, 2)) -> Column:
    """The last non-empty heading of the levels up to and with this block."""
    own = F.when((F.col("type") == "text") & F.col("text_level").isin(*levels), F.nullif(T.normalize_text("text"), F.lit("")))
    return F.coalesce(F.last(own, ignorenulls=True).over(in_doc().rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))


def segments(blocks: DataFrame, levels: tuple[int, ...] = (1, 2), sticky: bool = True, prefix: bool = True, page_sizes: DataFrame | None = None) -> DataFrame:
    """One row per block with text: doc_id, block_idx, type, text, page_idx, bbox, is_special, special_type, header."""
    rows = kept(blocks)
    if page_sizes is not None:
        rows = rows.join(page_sizes.select("page_idx", "width", "height"), "page_idx", "left").withColumn("bbox", T.normalize_bbox(F.col("bbox"), F.col("width"), F.col("height")))
    special = F.coalesce(F.col("type").isin(*SPECIAL), F.lit(False))
    rows = rows.select(
        "doc_id",
        "block_idx",
        "type",
        T.normalize_text(block_text(prefix=prefix)).alias("text"),
        "page_idx",
        "bbox",
        special.alias("is_special"),
        F.when(special, F.col("type")).alias("special_type"),
        (sticky_header(levels) if sticky else F.lit("")).alias("header"),
    )
    return rows.where("text <> ''")


def with_offsets(segs: DataFrame, separator: str = " ") -> DataFrame:
    """Adds the prefix that announces a new header, and the half-open span of prefix and text in the document's full text."""
    before = F.lag("header").over(in_doc())
    new = (F.col("header") != "") & ~F.col("header").eqNullSafe(before)
    shown = F.contains(F.lower(F.left("text", F.length("header") + 10)), F.lower("header"))
    prefix = F.when(new & ~shown, F.concat("header", F.lit(".\n"))).otherwise("")
    rows = segs.withColumn("prefix", prefix)
    size = (F.length("prefix") + F.length("text")).cast("long")
    prior = F.coalesce(F.sum(size + len(separator)).over(in_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("seg_start", prior.cast("long")).withColumn("seg_end", F.col("seg_start") + size)


def full_text(segs: DataFrame, separator: str = " ") -> DataFrame:
    """(doc_id, full_text, spans): each document's text, and start, end and kind of its segments in order."""
    row = F.struct("block_idx", F.concat("prefix", "text").alias("t"), F.col("seg_start").alias("s"), F.col("seg_end").alias("e"), "is_special", "special_type")
    rows = segs.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select("doc_id", F.array_join(F.col("r.t"), separator).alias("full_text"), F.transform("r", lambda x: F.struct(x["block_idx"].alias("block_idx"), x["s"].alias("s"), x["e"].alias("e"), x["is_special"].alias("is_special"), x["special_type"].alias("special_type"))).alias("spans"))


def neighbour_context(blocks: DataFrame, width: int = 250, separator: str = " ") -> DataFrame:
    """Adds ``left`` and ``right``: the nearest ``width`` characters around each block, from raw texts.

    Blocks are counted without the blank ones, and as each has a character and a
    separator at least, no text beyond half the width matters; of each, no more than
    the width.
    """
    raw = F.nullif(T.normalize_text(block_text(use_description=False)), F.lit(""))
    rows = kept(blocks).withColumn("_raw", raw)
    rows = rows.withColumn("_k", F.count("_raw").over(in_doc().rowsBetween(Window.unboundedPreceding, 0)))
    counted, most = Window.partitionBy("doc_id").orderBy("_k"), width // (1 + len(separator)) + 1
    near = lambda c, a, b: F.collect_list(c).over(counted.rangeBetween(a, b))
    ends, heads = F.right("_raw", F.lit(width)), F.left("_raw", F.lit(width))
    before = near(ends, -most, -1)
    # a blank block has the number of the text before it
    last = F.last(ends, ignorenulls=True).over(in_doc().rowsBetween(Window.unboundedPreceding, 0))
    before = F.when(F.col("_raw").isNull() & last.isNotNull(), F.array_append(before, last)).otherwise(before)
    rows = rows.withColumn("left", F.right(F.array_join(before, separator), F.lit(width))).withColumn("right", F.left(F.array_join(near(heads, 1, most), separator), F.lit(width)))
    return rows.drop("_raw", "_k")


def describe_special(blocks: DataFrame, model, template: str = "{context_block}", width: int = 250) -> DataFrame:
    """Fills ``llm_description`` of special blocks that have none by an injected model; its failures give ''."""
    rows = neighbour_context(blocks, width)
    asked = T.prompt(template, context_block=T.context_block(F.col("left"), F.col("right")), caption=caption(), type=F.col("type"))
    need = F.col("type").isin(*SPECIAL) & (F.coalesce("llm_description", F.lit("")) == "")
    return rows.withColumn("llm_description", F.when(need, model.column(asked, on_error="")).otherwise(F.col("llm_description"))).drop("left", "right")


# --- the packing chunker's segments -------------------------------------------------------------


def item_text() -> Column:
    """A block's text for the packing chunker: headings with marks, tables with their body."""
    text, lists = F.coalesce("text", F.lit("")), lambda *names: F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])
    body = F.when(F.coalesce("table_body", F.lit("")) != "", F.array("table_body")).otherwise(F.array().cast("array<string>"))
    table = F.concat(lists("table_caption"), body, lists("table_footnote"))
    heading = F.when(F.coalesce("text_level", F.lit(0)) != 0, F.concat(F.repeat(F.lit("#"), F.col("text_level")), F.lit(" "), text)).otherwise(text)
    return F.when(F.col("type") == "text", T.strip(heading)).when(F.col("type") == "image", T.join_text(lists("image_caption", "image_footnote"))).when(F.col("type") == "table", T.join_text(table)).otherwise(T.strip(text))


def images(base_dir: str = "") -> Column:
    """None or one image with its paths, captions and latex."""
    kind, path = F.col("type"), F.col("img_path")
    base = base_dir.rstrip("/") + "/" if base_dir else ""
    absolute = F.startswith(path, F.lit("/"))
    of = lambda a, b: F.nullif(F.when(kind == "image", T.join_text(a)).when(kind == "table", T.join_text(b)), F.lit(""))
    one = F.struct(
        F.when(absolute, path).otherwise(F.concat(F.lit(base), path)).alias("path"),
        F.when(absolute & F.startswith(path, F.lit(base or "/")), F.substring(path, len(base or "") + 1, 1 << 30)).otherwise(path).alias("path_rel"),
        kind.alias("type"),
        F.col("page_idx"),
        F.col("bbox"),
        of("image_caption", "table_caption").alias("caption"),
        of("image_footnote", "table_footnote").alias("footnote"),
        F.when(kind == "equation", F.nullif(F.col("text"), F.lit(""))).alias("latex"),
    )
    none = F.filter(F.array(one), lambda x: F.lit(False))
    return F.when(F.coalesce(path, F.lit("")) != "", F.array(one)).otherwise(none)


def packing_segments(blocks: DataFrame, base_dir: str = "") -> DataFrame:
    """One row per block that is not discarded and has text or an image."""
    rows = blocks.where(~F.col("type").eqNullSafe("discarded"))
    rows = rows.select("doc_id", "block_idx", item_text().alias("text"), "page_idx", "bbox", images(base_dir).alias("images"), F.col("type").alias("content_type"))
    return rows.where("text <> '' OR size(images) > 0")


def page_boxes(segs: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of each page."""
    rows = segs.where("page_idx IS NOT NULL AND size(bbox) = 4")
    corner = [F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3])]
    return rows.groupBy(*keys, "page_idx").agg(F.array(*corner).alias("bbox"))
