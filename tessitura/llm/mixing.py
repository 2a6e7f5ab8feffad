"""Mixing sources to target weights (operator 10).

Words are counted per source, every source gets a target and so a repetition rate
``target / size``, and each document is emitted floor(rate) times plus once more if
a hash of its id and the seed, read as a number in [0, 1), is below the fraction.

One draw leaves a source of few or of uneven documents far from its target.  So the documents of a
source lie in cells, by the binary length of their bytes and by four bits of the hash, and each cell has DRAWS
draws, the hash shifted around the unit interval by k / DRAWS, whose words are added up in one aggregation.
From the longest documents on, each cell takes the draw after which the words so far are nearest to what
the rate makes of them, among draws that the cells to come can make up for, the first of equal ones.  Each draw
alone copies a document with the chance that the rate says; the choice makes draws of a source depend on each other.
Off its target stays what no choice of whole documents can mend, as a document that is half of its source.

All of it is DataFrame work.  Words are counted once, into a table of ids, sources and sizes.  What is
aggregated stays a table, with one row for each source, and one for each cell in which there are documents (at most
16 for each binary length); only the table of sources is sorted as a whole, and the cells of one source are folded in one row.

Defined results: a null text has size 0 and a text of any length is counted as a whole; null is a
source of its own, the last; a source without words has rate 0; a null doc_id hashes like the empty
text; rows that repeat a doc_id have one hash, and equal copies if source and cell are equal too; an empty table gives an empty result.  Columns of
the input keep their names, and those added are looked up by names that no input has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.blocks import kept

#: Draws of a cell, and cells of one binary length.
DRAWS = CELLS = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of md5 that make a number below 2 ** 52, exact as a double.
_DIGITS, _RANGE = 13, float(1 << 52)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """sizes(source, source_size) with target: what each source shall give.

    Sources in code point order, null last, weigh ``weights`` over and over and share
    all sizes.  None gets more than ``most`` times its size; what it would have had
    goes to the others by weight, again and again.  In the order of most * size /
    weight the sources that are cut are the first ones, so the end of that process is
    found by running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_cut", F.col("_cap") * F.col("_rest") <= F.col("_w") * (F.col("_total") - F.col("_before")))
    )
    # the first source that isn't cut fixes the level; those after it aren't cut either
    first = F.min(F.when(~F.col("_cut"), F.struct(-F.col("_rest"), F.col("_before"))))
    ranked = ranked.withColumn("_level", first.over(everything))
    rest, before = -F.col("_level")["col1"], F.col("_level")["_before"]
    share = F.col("_w") * (F.col("_total") - before) / rest
    return ranked.select("source", "source_size", F.when(F.col("_cut"), F.col("_cap")).otherwise(F.least(share, F.col("_cap"))).cast("double").alias("target"))


def _shifted(u: Column, k: Column | int) -> Column:
    """u moved by k / DRAWS around the unit interval."""
    moved = u + (F.lit(k) if isinstance(k, int) else k) / F.lit(float(DRAWS))
    return moved - F.floor(moved)


def cell_of(text: Column, u: Column) -> Column:
    """The cell of a document: the binary length of its bytes, and the last bits of its hash."""
    digits = F.length(F.bin(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")))
    return (digits * CELLS + (u * F.lit(_RANGE)).cast("long") % CELLS).cast("int")


def cell_shifts(cells: DataFrame) -> DataFrame:
    """cells(source, cell, words, draws, source_size, part) to source, cell and shift, the draw that each cell takes."""
    folded = cells.groupBy("source", "source_size", "part").agg(F.sort_array(F.collect_list(F.struct("cell", "words", "draws")), asc=False).alias("cells"))

    def step(state: Column, cell: Column) -> Column:
        left = state["left"] - cell["words"]

        def judged(drawn: Column, k: Column) -> Column:
            off = state["off"] + (drawn.cast("double") - F.col("part") * cell["words"])
            lost = F.greatest(F.lit(0.0), off - F.col("part") * left, -off - (F.lit(1.0) - F.col("part")) * left)
            return F.struct(lost.alias("lost"), F.abs(off).alias("far"), k.alias("k"), off.alias("off"))

        best = F.array_min(F.transform(cell["draws"], judged))
        return F.struct(best["off"].alias("off"), left.alias("left"), F.concat(state["taken"], F.array(F.struct(cell["cell"].alias("cell"), best["k"].alias("shift")))).alias("taken"))

    start = F.struct(F.lit(0.0).alias("off"), F.col("source_size").alias("left"), F.array().cast("array<struct<cell:int,shift:int>>").alias("taken"))
    return folded.select("source", F.inline(F.aggregate("cells", start, step, lambda state: state["taken"])))


def source_rates(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sized(source, size, u, cell) to source, cell, source_size, target, rate and shift; a row for each cell of each source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = kept(source_targets(sizes, weights, most).withColumn("rate", rate), "source-rates")
    rates = rates.withColumn("part", F.col("rate") - F.floor("rate"))
    of_source = rates.withColumnRenamed("source", "__s")
    same = F.col("source").eqNullSafe(F.col("__s"))
    drawn = F.array(*(F.sum(F.when(_shifted(F.col("u"), k) < F.col("part"), F.col("size")).otherwise(0)) for k in range(DRAWS)))
    cells = sized.join(of_source.select("__s", "source_size", "part"), same).groupBy("source", "cell", "source_size", "part").agg(F.sum("size").alias("words"), drawn.alias("draws"))
    return cell_shifts(cells).join(of_source, same).select("source", "cell", "source_size", "target", "rate", "shift")


def copies_of(rates: Column, u: Column) -> Column:
    """How often a document of number u is emitted."""
    rate = rates["rate"]
    return (F.floor(rate) + (_shifted(u, rates["shift"]) < rate - F.floor(rate)).cast("long")).cast("int")


def with_rates(df: DataFrame, rates: DataFrame, source_col: str, cell_col: str = "cell") -> DataFrame:
    """df with ``__r``, the row of its source and cell."""
    own = rates.select(F.struct(*rates.columns).alias("__r"))
    return df.join(own, F.col(f"`{source_col}`").eqNullSafe(F.col("__r.source")) & (F.col(f"`{cell_col}`") == F.col("__r.cell")), "left")


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(a row for each of docs: id, source, size, u, cell; the rates of the sources by cell)."""
    q = lambda c: F.col(f"`{c}`")
    sized = docs.select(q(id_col).alias("id"), q(source_col).alias("source"), word_count(q(text_col)).alias("size"), hash_unit(seed, q(id_col)).alias("u"), q(text_col).alias("text"))
    sized = kept(sized.withColumn("cell", cell_of(F.col("text"), F.col("u"))).drop("text"), "sizes")
    return sized, source_rates(sized, weights, most)


def mix_sources(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: the rows of docs, each as often as the rates of its source say.

    The columns are those of docs.
    """
    _, rates = mixture(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    placed = docs.withColumn("__u", hash_unit(seed, F.col(f"`{id_col}`"))).withColumn("__cell", cell_of(F.col(f"`{text_col}`"), F.col("__u")))
    made = with_rates(placed, rates, source_col, "__cell").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies_of(F.col("__r"), F.col("__u")))))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    sized, rates = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("size") * copies_of(F.col("__r"), F.col("u"))).cast("long")
    return with_rates(sized, rates, "source").select(F.col("id").alias("doc_id"), "size", "__r.source_size", "__r.target", taken.alias("taken"))


OP10_SQL = r"""
WITH RECURSIVE e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(strlen(text), 0)::BIGINT AS bytes,
             ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS hash FROM documents),
d AS (SELECT doc_id, source, size, hash / 4503599627370496.0::DOUBLE AS u, (length(bin(bytes)) * 16 + hash % 16)::INT AS cell FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w,
             3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
             sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, cap * rest <= w * (total - before) AS cut FROM r),
l AS (SELECT arg_max(before, rest) AS before, max(rest) AS rest FROM c WHERE NOT cut),
t AS (SELECT c.source, c.source_size, CASE WHEN c.cut THEN c.cap ELSE least(c.w * (c.total - l.before) / l.rest, c.cap) END AS target FROM c CROSS JOIN l),
x AS (SELECT d.doc_id, d.source, d.size, d.u, d.cell, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT source, cell, k, any_value(rate) - floor(any_value(rate)) AS part, sum(size)::BIGINT AS words,
             sum(CASE WHEN u + k / 16.0::DOUBLE - floor(u + k / 16.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END)::BIGINT AS drawn
      FROM x, range(16) t(k) GROUP BY source, cell, k),
g AS (SELECT source, cell, any_value(part) AS part, any_value(words) AS words, list(drawn ORDER BY k) AS draws FROM p GROUP BY source, cell),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell DESC) AS i,
             coalesce(sum(words) OVER (PARTITION BY source ORDER BY cell DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS remain FROM g),
f AS (SELECT source, 0::BIGINT AS i, 0::INT AS cell, 0.0::DOUBLE AS off, 0::BIGINT AS k FROM (SELECT DISTINCT source FROM g)
      UNION ALL
      SELECT source, i, cell, best.off, best.k FROM (
        SELECT h.source, h.i, h.cell, list_min(list_transform(range(16), lambda k: {
                 'lost': greatest(0.0::DOUBLE, (f.off + (h.draws[k + 1] - h.part * h.words)) - h.part * h.remain, -(f.off + (h.draws[k + 1] - h.part * h.words)) - (1.0::DOUBLE - h.part) * h.remain),
                 'far': abs(f.off + (h.draws[k + 1] - h.part * h.words)), 'k': k, 'off': f.off + (h.draws[k + 1] - h.part * h.words)})) AS best
        FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source AND h.i = f.i + 1))
SELECT x.doc_id, x.size, x.source_size, x.target::DOUBLE AS target,
       (x.size * (floor(x.rate)::BIGINT + (x.u + f.k / 16.0::DOUBLE - floor(x.u + f.k / 16.0::DOUBLE) < x.rate - floor(x.rate))::BIGINT))::BIGINT AS taken
FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND x.cell = f.cell AND f.i > 0
"""
