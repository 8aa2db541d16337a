"""Joins of predicted lines with ground truth: by position, by nearest match, and by order-preserving alignment."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import half_even, macro
from ..functions.text import let, normalise
from ..sources import shared
from . import page_table
from .distance import between
from .page_table import MATCH, SKIP_PRED, SKIP_TRUTH
from .spread import spread

#: The nearest-match search holds all candidates in one array; more bytes than these are first searched by shared grams.
CANDIDATE_BYTES = 8 << 20
#: Letters in a gram, and the distances up to which lines are searched by these, one after another.
GRAM, REACH = 3, (1, 2, 4, 8)
#: Hashes of grams that lines are counted by; pivots, their letters where there is a choice, rings, and lines that one part of a ring has.
BUCKETS, PIVOTS, PIVOT_LETTERS, RINGS, PART = 1 << 16, 16, 256, 1 << 16, 4096


def positional(left: DataFrame, right: DataFrame, keys: list[str], text_col: str = "gt") -> DataFrame:
    """Left rows with the text at their position; '' and matched = false where there is none."""
    out = left.join(right.select(*keys, text_col), keys, "left")
    return out.withColumns({"matched": F.col(text_col).isNotNull(), text_col: F.coalesce(text_col, F.lit(""))})


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right rows without a partner."""
    return right.join(left.select(*keys), keys, "left_anti")


def _best(text: Column, candidates: Column) -> Column:
    """struct(distance, i, gt) of the candidate (t, i, gt) nearest to a text, the first of equally near ones.

    Each distance is computed no further than what is best so far.
    """

    def search(x, all_):
        def step(acc, c):
            d = F.call_function("levenshtein", x, c["t"], acc["distance"] - 1)
            return F.when((acc["distance"] > 0) & (d >= 0), F.struct(d.alias("distance"), c["i"].alias("i"), c["gt"].alias("gt"))).otherwise(acc)

        longest = F.greatest(F.length(x), F.coalesce(F.array_max(F.transform(all_, lambda c: F.length(c["t"]))), F.lit(0)))
        none = F.struct((longest + 1).cast("int").alias("distance"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("gt"))
        found = F.aggregate(all_, none, step)
        return F.when(x.isNotNull() & (F.size(all_) > 0), found)

    return let(search, x=text, all_=candidates)


def _grams(x: Column) -> Column:
    return F.when(F.length(x) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (GRAM - 1)), lambda i: F.substring(x, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _gram_counts(lines: DataFrame) -> DataFrame:
    """One row `seen`: the number of lines with a gram of each of BUCKETS hashes."""
    counts = lines.select(F.explode(_grams(F.col("t"))).alias("g")).groupBy(F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(BUCKETS).withColumnRenamed("id", "b").join(counts, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("n", F.lit(0)).alias("n")))), lambda s: s["n"]).alias("seen"))


def _rare_first(x: str, counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the grams `g` of x in one order for all: those that few lines have come first."""

    def ordered(grams: Column, seen: Column) -> Column:
        keyed = F.transform(grams, lambda g: F.struct(F.get(seen, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")).alias("n"), F.xxhash64(g).alias("h"), g.alias("g")))
        return F.transform(F.array_sort(keyed), lambda s: s["g"])

    return rows.crossJoin(F.broadcast(counts)).withColumn("g", let(ordered, grams=_grams(F.col(x)), seen=F.col("seen"))).drop("seen")  # one row of BUCKETS numbers


def _by_grams(texts: DataFrame, lines: DataFrame, reach: int) -> DataFrame:
    """(x, m) of the texts with a line at most `reach` away: the nearest.

    Such a pair shares one of the first GRAM * reach + 1 grams of either side; texts with fewer grams aren't asked for.
    """
    most = GRAM * reach + 1
    asked = texts.where(F.size("g") >= most).select("x", F.explode(F.slice("g", 1, most)).alias("gram"))
    held = lines.select("t", F.explode(F.slice("g", 1, most)).alias("gram"))
    pairs = asked.join(held, "gram").where(F.abs(F.length("x") - F.length("t")) <= reach).select("x", "t").distinct()
    near = pairs.withColumn("d", F.levenshtein("x", "t", reach)).where("d >= 0").join(lines, "t")
    return near.groupBy("x").agg(F.min(F.struct(F.col("d").alias("distance"), "i", "gt")).alias("m"))


def _by_pivots(texts: DataFrame, lines: DataFrame, folder: str) -> DataFrame:
    """(x, m) of every text, whatever its distance: by distances from a few lines, the pivots.

    A line lies in the cell of its nearest pivot, on a ring of its distance from that.  The nearest pivot bounds how far a
    text's nearest line can be, so it asks only rings that a line within this bound can lie on, and compares only lines
    whose distances from all pivots allow it.  A ring with many lines is dealt into parts of about PART.
    """
    pivots = [r.t for r in lines.orderBy(F.length("t") > PIVOT_LETTERS, F.xxhash64("t"), "t").limit(PIVOTS).select("t").collect()]
    far = lambda c: F.array(*(F.levenshtein(F.col(c), F.lit(p)) for p in pivots))
    held = lines.withColumn("v", far("t")).withColumn("cell", F.array_position("v", F.array_min("v")).cast("int"))
    longest = lines.agg(F.max(F.length("t"))).first()[0]
    width = 1 + PIVOTS * (longest + 1) // RINGS
    held = shared.saved(held.withColumn("ring", F.floor(F.element_at("v", F.col("cell")) / width).cast("int")).drop("g"), folder, "held")
    rings = held.groupBy("cell", "ring").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # RINGS rows at most
    asked = texts.select("x", far("x").alias("u")).withColumn("reach", F.array_min("u")).select("x", "u", "reach", F.posexplode("u").alias("cell", "d"))
    asked = asked.withColumn("cell", F.col("cell") + 1).join(F.broadcast(rings), "cell").where(f"ring between floor((d - reach) / {width}) and floor((d + reach) / {width})")
    asked = asked.select("x", "u", "reach", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = held.join(F.broadcast(rings), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")).drop("parts")
    apart = F.array_max(F.zip_with("u", "v", lambda a, b: F.abs(a - b)))
    pairs = asked.join(held, ["cell", "ring", "part"]).where((F.abs(F.length("x") - F.length("t")) <= F.col("reach")) & (apart <= F.col("reach")))
    near = pairs.withColumn("d", F.call_function("levenshtein", F.col("x"), F.col("t"), F.col("reach"))).where("d >= 0")
    return near.groupBy("x").agg(F.min(F.struct(F.col("d").alias("distance"), "i", "gt")).alias("m"))


def nearest(preds: DataFrame, truth: DataFrame, pred_col: str = "pred", text_col: str = "gt", index_col: str = "gt_idx") -> DataFrame:
    """Each prediction with the truth line of least distance, lower-cased; the lowest index wins ties; lines may repeat.

    The lines go to the tasks as one array if their size is below the bound, and no pair becomes a row.  Otherwise distinct
    predictions look for lines by shared grams, in growing distance, and those that have none near by distances from
    pivots.  A null prediction, or any without truth lines, has a null partner; null lines are none.
    """
    lines = truth.where(F.col(text_col).isNotNull()).select(F.lower(F.col(text_col)).alias("t"), F.col(index_col).cast("long").alias("i"), F.col(text_col).alias("gt"))
    size = lines.agg(F.coalesce(F.sum(F.length("t") * 2 + 32), F.lit(0))).first()[0]
    out = [*preds.columns, F.col("__m.distance").alias("distance"), F.col("__m.i").alias("matched_idx"), F.col("__m.gt").alias("matched_gt")]
    if size <= CANDIDATE_BYTES:
        packed = lines.agg(F.array_sort(F.collect_list(F.struct("i", "t", "gt"))).alias("__all"))
        return spread(preds).crossJoin(F.broadcast(packed)).withColumn("__m", _best(F.lower(F.col(pred_col)), F.col("__all"))).select(out)  # one row, of checked size
    folder = shared.new_folder(preds.sparkSession, "nearest")
    lines = lines.groupBy("t").agg(F.min(F.struct("i", "gt")).alias("m")).select("t", "m.*")
    counts = shared.saved(_gram_counts(lines), folder, "counts")
    lines = shared.saved(_rare_first("t", counts, lines), folder, "lines")
    left = shared.saved(_rare_first("x", counts, preds.select(F.lower(F.col(pred_col)).alias("x")).where("x is not null").distinct()), folder, "texts")
    found = []
    for reach in REACH:
        found.append(shared.saved(_by_grams(left, lines, reach), folder, f"found-{reach}"))
        left = left.join(found[-1], "x", "left_anti")
    left = shared.saved(left.select("x"), folder, "strangers")
    found.append(shared.saved(_by_pivots(left, lines, folder), folder, "found"))
    known = reduce(DataFrame.unionByName, found).select(F.col("x").alias("__x"), F.col("m").alias("__m"))
    return preds.join(known, F.lower(F.col(pred_col)) == F.col("__x"), "left").select(out)


def alignment_path(p: Column, g: Column) -> Column:
    """The cheapest monotone alignment of two arrays of up to a few dozen lines, as a struct of cost and path, for use in expressions.

    The path has M for a matched pair, P for a prediction without partner, G for a truth line without.  Costs are the
    distance of lower-cased lines, and a skipped line's length; ties go to M, then P, then G.  The table is folded row by
    row: a cell is (cost, order of the last step, path), so the least struct is the choice.
    """
    return let(_path, p=p, g=g, low_p=F.transform(p, F.lower), low_g=F.transform(g, F.lower))


def _path(p: Column, g: Column, low_p: Column, low_g: Column) -> Column:
    cell = lambda c, o, path: F.struct(c.cast("int").alias("c"), F.lit(o).alias("o"), path.alias("path"))
    first = F.aggregate(
        g,
        F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("o"), F.lit("").alias("path"))),
        lambda row, t: F.concat(row, F.array(cell(F.element_at(row, -1)["c"] + F.length(t), SKIP_TRUTH, F.concat(F.element_at(row, -1)["path"], F.lit("G"))))),
    )

    def next_row(above, k):
        x = F.element_at(p, k)
        start = F.array(cell(F.element_at(above, 1)["c"] + F.length(x), SKIP_PRED, F.concat(F.element_at(above, 1)["path"], F.lit("P"))))

        def step(row, j):
            t = F.element_at(g, j)
            diagonal, up, left = F.element_at(above, j), F.element_at(above, j + 1), F.element_at(row, -1)
            options = F.array(
                cell(diagonal["c"] + F.levenshtein(F.element_at(low_p, k), F.element_at(low_g, j)), MATCH, F.concat(diagonal["path"], F.lit("M"))),
                cell(up["c"] + F.length(x), SKIP_PRED, F.concat(up["path"], F.lit("P"))),
                cell(left["c"] + F.length(t), SKIP_TRUTH, F.concat(left["path"], F.lit("G"))),
            )
            return F.concat(row, F.array(F.array_min(options)))

        return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, step)

    last = F.element_at(F.aggregate(F.sequence(F.lit(1), F.size(p)), first, next_row), -1)
    only_pred = F.struct(F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)).alias("cost"), F.repeat(F.lit("P"), F.size(p)).alias("path"))
    only_truth = F.struct(F.aggregate(g, F.lit(0), lambda a, x: a + F.length(x)).alias("cost"), F.repeat(F.lit("G"), F.size(g)).alias("path"))
    return F.when(F.size(g) == 0, only_pred).when(F.size(p) == 0, only_truth).otherwise(F.struct(last["c"].alias("cost"), last["path"].alias("path")))


def text_distances(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with the distance of two of their text columns under each name, and without the texts; null where either is.

    Distances of a batch are taken together, and of equal texts or pairs that come again once.
    """
    used = {c for pair in pairs.values() for c in pair}
    kept = [c for c in rows.columns if c not in used]

    def run(batches):
        for batch in batches:
            texts = {c: batch.column(c).to_pylist() for c in used}
            both = [(x, y) for a, b in pairs.values() for x, y in zip(texts[a], texts[b], strict=True)]
            there = [pair for pair in both if None not in pair]
            d = iter(between([x for x, _ in there], [y for _, y in there]).tolist())
            found = [None if None in pair else next(d) for pair in both]
            n = batch.num_rows
            out = [pa.array(found[i * n : (i + 1) * n], pa.int32()) for i in range(len(pairs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, *pairs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"`{k}` int" for k in pairs)]))


def align_pages(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per prediction, in page order: its partner in the page's cheapest monotone alignment, or skipped.

    preds: page_id, pred_idx, pred; truth: page_id, gt_idx, gt.  One shuffle brings a page's lines together, and a table in
    the page's task aligns them (`page_table`); a page's arrays are in its rows no more.  A null line is an empty one; a page
    without predictions has no rows, one without truth has all of its predictions skipped.
    """
    ordered = lambda d, i, x, name: spread(d, "page_id").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(i).cast("int").alias("i"), F.coalesce(F.col(x), F.lit("")).alias("x")))), lambda s: s["x"]).alias(name))
    pages = ordered(preds, "pred_idx", "pred", "p").join(ordered(truth, "gt_idx", "gt", "g"), "page_id", "left").withColumn("g", F.coalesce("g", F.array().cast("array<string>")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "p", "g").mapInArrow(page_table.partners, page_table.PARTNERS)
    return pair_rows(rows)


def pair_rows(partners: DataFrame, *more: str) -> DataFrame:
    """Rows of `page_table.PARTNERS` with rates and flags, and `more` of their columns."""
    hit, match, distance = F.col("matched_gt_idx") >= 0, F.col("matched_gt"), F.col("edit_distance")
    return partners.select(
        "page_id", "pred_idx", "pred_text", "matched_gt", "matched_gt_idx", "edit_distance", half_even(distance / F.greatest(F.length(match), F.lit(1)), 4).alias("cer"),
        (hit & (F.col("matched_gt_idx") != F.col("pred_idx"))).alias("was_shifted"), (~hit).alias("skipped"), "path_cost", *more,
    )


def aggregate_rates(pairs: DataFrame, *keys: str) -> DataFrame:
    """Case-insensitive rates over matched lines, and counts of shifted, skipped and all."""
    kept = ~F.col("skipped")
    size = F.greatest(F.length("matched_gt"), F.lit(1))
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(kept, F.col("edit_distance"))), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("ref_len"),
        F.round(F.coalesce(F.avg(F.when(kept, F.col("cer"))), F.lit(0.0)), 9).alias("mean_line_cer"),
        F.count_if("was_shifted").alias("shifted"), F.count_if("skipped").alias("skipped"), F.count("*").alias("total"),
    ).withColumn("total_cer", F.col("edits") / F.greatest("ref_len", F.lit(1)))


def stage_rates(pairs: DataFrame, stages: DataFrame, names: list[str], *keys: str, most: float | None = None) -> DataFrame:
    """(keys, stage, cer, norm_cer, lines, excluded): mean rates of each stage's texts against the same partners.

    pairs: the alignment of the last stage; stages: page_id, pred_idx and a column of each name, in order.  Skipped lines and
    empty partners have no rate; with `most`, lines whose last stage has a higher rate are left out, and counted.
    """
    place = ["page_id", "pred_idx"]
    rows = spread(pairs.where("not skipped and matched_gt <> ''"), *place).join(spread(stages, *place), place)
    gt = F.col("matched_gt")
    texts = {f"{k}{i}": f(F.col(n)) for i, n in enumerate(names) for k, f in (("r", lambda x: x), ("q", normalise))}
    sizes = [F.greatest(F.length(y), F.lit(1)).alias(k) for k, y in (("gt_size", gt), ("norm_size", normalise(gt)))]
    rows = rows.select(*keys, *sizes, gt.alias("gt_r"), normalise(gt).alias("gt_q"), *(x.alias(k) for k, x in texts.items()))
    rows = text_distances(rows, {k: (k, f"gt_{k[0]}") for k in texts})
    rate = lambda k: F.col(k) / F.col("gt_size" if k[0] == "r" else "norm_size")
    out_ = rate(f"r{len(names) - 1}") > most if most is not None else F.lit(False)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), rate(f"r{i}").alias("r"), rate(f"q{i}").alias("q")) for i, n in enumerate(names)]))
    flat = rows.select(*keys, out_.alias("out"), each.alias("s")).select(*keys, "out", "s.*")
    return flat.groupBy(*keys, "stage").agg(macro(F.when(~F.col("out"), F.col("r"))).alias("cer"), macro(F.when(~F.col("out"), F.col("q"))).alias("norm_cer"), F.count_if(~F.col("out")).alias("lines"), F.count_if("out").alias("excluded"))


def sequential_rate(preds: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Case-sensitive rate over positions that both sides have."""
    both = preds.withColumnRenamed("pred_idx", "i").join(truth.withColumnRenamed("gt_idx", "i"), ["page_id", "i"])
    return both.groupBy(*keys).agg(F.sum(F.levenshtein("pred", "gt")).alias("edits"), F.sum(F.length("gt")).alias("ref_len"), F.count("*").alias("lines")).withColumn("cer", F.col("edits") / F.greatest("ref_len", F.lit(1)))
