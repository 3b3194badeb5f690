"""Coverage maps (map, bb, t): set algebra, suite selection, series, and line coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import checkpoints
from strandlog.functions.running import running


def unique_blocks(maps: DataFrame) -> DataFrame:
    return maps.select("map", "bb").distinct()


def well_formed(maps: DataFrame) -> DataFrame:
    return maps.where(F.col("bb").rlike("^[0-9a-z]{16}$"))


def shifted(maps: DataFrame, by: int = 5) -> DataFrame:
    """Block addresses moved by some bytes, as 16 hexadecimal digits."""
    return maps.withColumn("bb", F.lpad(F.lower(F.hex(F.conv("bb", 16, 10).cast("long") + by)), 16, "0"))


def bitmap_decoded(words: DataFrame, base: int, width: int = 64) -> DataFrame:
    """bb of each set bit: bit j of the i-th word stands for base + i * width + j. `words` has map, i and word."""
    bits = words.select("map", "i", "word", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    return bits.where(F.expr("shiftright(word, j) & 1") == 1).select("map", (F.lit(base) + F.col("i") * width + F.col("j")).alias("bb"))


def union(maps: DataFrame, names: list) -> DataFrame:
    return maps.where(F.col("map").isin(names)).select("bb").distinct()


def intersection(maps: DataFrame, names: list) -> DataFrame:
    return maps.where(F.col("map").isin(names)).groupBy("bb").agg(F.countDistinct("map").alias("n")).where(F.col("n") == len(set(names))).select("bb")


def minus(maps: DataFrame, name, other) -> DataFrame:
    return maps.where(F.col("map") == name).select("bb").distinct().join(maps.where(F.col("map") == other).select("bb"), "bb", "left_anti")


def of_subsystem(maps: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """Blocks that have a source line whose file matches, once each."""
    return maps.select("bb").distinct().join(lines.where(F.col("file").rlike(pattern)), "bb", "left_semi")


#: Words of 64 blocks in a row of a map's bitmap, at most, and how many maps are paired with as many others at a time.
WORDS, PART = 16, 1024
#: Parts that maps are dealt to, so that each bitmap is sent as often, unless a part would have more than some ROOM bytes; and pairs of a batch that goes out.
PARTS, ROOM, PAIRS = 24, 1 << 25, 1 << 17


def bitmaps(maps: DataFrame, words: int = WORDS) -> DataFrame:
    """map, bucket, piece, w0, w1, ..: the blocks of each map as bits of 64-bit words, a row for each piece of a bucket in which it has any.

    Blocks are dealt to buckets by their hash and numbered within them; as many buckets are made as half fill a piece, one that is overfull has more pieces. Blocks of a single map
    have no bit: they are in no intersection.
    """
    u = unique_blocks(maps).where("bb is not null and map is not null")
    shared = u.groupBy("bb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bb")
    room = 64 * words
    found = shared.count()
    buckets = found * 2 // room + 1
    if buckets == 1:
        words = max(-(-found // 64), 1)  # a single piece, which none overfills
    dealt = shared.withColumn("bucket", F.pmod(F.xxhash64("bb"), F.lit(buckets)))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("bb")) - 1
    slots = dealt.withColumn("at", at).select("bb", "bucket", F.floor(F.col("at") / room).cast("int").alias("piece"), (F.col("at") % room).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    columns = [F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / 64) == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(words)]
    return u.join(slots, "bb").groupBy("map", "bucket", "piece").agg(*columns)


def whole_groups(batches):
    """The rows of each group as a table, from batches that are sorted by group."""
    import numpy as np
    import pyarrow as pa

    held, at = [], None
    for batch in batches:
        group = batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for low, high in zip(cuts, cuts[1:]):
            if held and low < high and group[low] != at:
                yield pa.Table.from_batches(held)
                held = []
            if low < high:
                held.append(batch.slice(low, high - low))
                at = group[low]
    if held:
        yield pa.Table.from_batches(held)


def tiles(t, part: int) -> list[tuple]:
    """(names, at, slot, bits) of `part` maps at a time: rows of bits, sorted by the piece that they are of, with their map's place among the names."""
    import numpy as np

    coded = t.column("map").combine_chunks().dictionary_encode()
    at, slot = coded.indices.to_numpy(), t.column("bucket").to_numpy() * (1 << 20) + t.column("piece").to_numpy()
    order = np.lexsort((at, slot, at // part))
    at, slot, bits = at[order], slot[order], np.stack([t.column(c).to_numpy() for c in t.column_names if c.startswith("w")], 1)[order]
    edges = np.searchsorted(at // part, np.arange(-(-len(coded.dictionary) // part) + 1))
    return [(coded.dictionary.slice(k * part, part), at[low:high] - k * part, slot[low:high], bits[low:high]) for k, (low, high) in enumerate(zip(edges, edges[1:]))]


def overlaps(left: tuple, right: tuple):
    """Blocks that each two maps of two tiles share, as a matrix: piece by piece, by products of matrices of bits."""
    import numpy as np

    def unpacked(bits):
        return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.float32)

    (a_names, a_at, a_slot, a_bits), (b_names, b_at, b_slot, b_bits) = left, right
    n = np.zeros((len(a_names), len(b_names)), np.int64)
    for slot in np.intersect1d(a_slot, b_slot):
        a, b = (slice(*np.searchsorted(s, [slot, slot + 1])) for s in (a_slot, b_slot))
        product = unpacked(a_bits[a]) @ unpacked(b_bits[b]).T
        if product.shape == n.shape:  # rows are in the order of their maps
            n += product.astype(np.int64)
        else:
            n[np.ix_(a_at[a], b_at[b])] += product.astype(np.int64)
    return n


def paired(batches, part: int):
    """map_a, map_b, n as batches of Arrow, from bitmaps sorted by group: pairs of one part's maps, or of two parts' in both orders. A pair goes out when its tiles have met."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for t in whole_groups(batches):
        parts = [tiles(t.filter(pc.equal(t.column("own"), own)), part) for own in pc.unique(t.column("own"))]
        same = len(parts) == 1 and t.column("alone")[0].as_py()
        if len(parts) == 1 and not same:
            continue  # the other part has no map
        for i, a in enumerate(parts[0]):
            for b in parts[0][i:] if same else parts[1]:
                n = overlaps(a, b)
                if a is b:
                    np.fill_diagonal(n, 0)
                flat = n.ravel()
                found = np.flatnonzero(flat)
                for k in range(0, len(found), PAIRS):
                    x, y = np.divmod(found[k : k + PAIRS], n.shape[1])
                    sides = [a[0].take(pa.array(x)), b[0].take(pa.array(y))]
                    shared = pa.array(flat[found[k : k + PAIRS]])
                    for names in [sides] if a is b else [sides, sides[::-1]]:
                        yield pa.RecordBatch.from_arrays([*names, shared], ["map_a", "map_b", "n"])


def pairwise_intersections(maps: DataFrame, words: int = WORDS, part: int = PART, most: int = PARTS) -> DataFrame:
    """Sizes of the intersections of all ordered pairs of maps that share a block, by bitmaps.

    Maps are dealt to parts by their hash; two parts are a group, for which a task keeps their bitmaps and a count for each pair of `part` maps and as many others, whose pairs go out before the next ones are counted.
    A bitmap is sent once for each part. There are `most` parts however many maps there are, and more only where a part's bitmaps would take too much of a task's memory. No pair is moved or written: there are as many as the square of the maps at worst, all of them rows of the result.
    """
    rows = checkpoints.kept(bitmaps(maps, words), "coverage-bitmaps")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("map").alias("maps")).first()
    parts = max(min(size["maps"] // part + 1, most), size["rows"] * (8 * len(rows.columns) + 32) // ROOM + 1)
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = rows.withColumn("own", F.pmod(F.xxhash64("map"), F.lit(parts)).cast("int")).withColumn("other", other)
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    tasks = min(parts * (parts + 1) // 2, 1 << 12)
    grouped = own.withColumn("group", F.floor(high * (high + 1) / 2) + low).withColumn("alone", F.col("own") == F.col("other")).drop("other").withColumn("task", (F.col("group") % tasks).cast("int"))
    of = dict(maps.dtypes)["map"]
    dealt = grouped.repartitionById(tasks, "task").drop("task").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda batches: paired(batches, part), f"map_a {of}, map_b {of}, n long")


def suite_overlaps(suites: DataFrame) -> DataFrame:
    """Size of the intersection of every set of suites that share a block; `suites` has suite (string) and bb. The number of suites is small."""
    sets = suites.groupBy("bb").agg(F.array_sort(F.collect_set("suite")).alias("suites"))
    subsets = F.aggregate("suites", F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return sets.select(F.explode(subsets).alias("s")).where(F.size("s") > 0).groupBy(F.array_join("s", "&").alias("suites")).agg(F.count(F.lit(1)).alias("n"))


#: Maps of a round of set_cover: what the driver gets of them has at most 2^TOP rows.
TOP = 14


def picked(masks: dict[int, int], names: list, after: tuple | None) -> list[tuple[int, int]]:
    """(place, gain) of greedy picks among the top maps, as far as no other map can come before them. `masks` counts blocks by the top maps that have them.

    `names` are the top maps' in the order of their names; `after` is the gain and name of the next map, an upper bound for all that aren't here.
    """
    left, picks = dict(masks), []
    while left:
        gains = [sum(n for mask, n in left.items() if mask >> k & 1) for k in range(len(names))]
        best = max(range(len(names)), key=lambda k: (gains[k], -k))
        if not gains[best] or after is not None and (gains[best] < after[0] or gains[best] == after[0] and names[best] > after[1]):
            break
        picks.append((best, gains[best]))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return picks


def set_cover(maps: DataFrame, restrict: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """step, map, gain, total: greedily the map that adds most, the smallest name of equals, until nothing is left (or `most` steps are taken).

    Gains only fall, so that those of the last round are upper bounds. A round takes the maps with the largest ones and counts the blocks left by which of these maps have
    them; from these counts the driver makes all picks that no map outside can come before, one at least. Their blocks then go from all maps by one anti join. The driver holds a
    row for each step, as the result does.
    """
    spark = maps.sparkSession
    left = unique_blocks(maps) if restrict is None else unique_blocks(maps).join(restrict.select("bb"), "bb", "left_semi")
    checkpoints.prepared(spark)
    steps, total = [], 0
    left = left.checkpoint()
    while most is None or len(steps) < most:
        best = left.groupBy("map").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "map").limit(TOP + 1).collect()
        if not best:
            break
        names = sorted(r["map"] for r in best[:TOP])
        place = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)])
        shared = left.where(F.col("map").isin(names)).groupBy("bb").agg(F.bit_or(place[F.col("map")]).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
        found = picked({r["mask"]: r["n"] for r in shared.collect()}, names, (best[TOP]["n"], best[TOP]["map"]) if len(best) > TOP else None)
        for k, gain in found[: None if most is None else most - len(steps)]:
            total += gain
            steps.append((len(steps) + 1, names[k], gain, total))
        taken = [names[k] for k, _ in found]
        left = left.join(left.where(F.col("map").isin(taken)).select("bb"), "bb", "left_anti").checkpoint()
    return spark.createDataFrame(steps, f"step int, map {dict(maps.dtypes)['map']}, gain long, total long")


def cumulative(maps: DataFrame, subset: Column, baseline: DataFrame | None = None) -> DataFrame:
    """map, t, current, current_subset, aggregate, aggregate_subset: maps in the order of their first time; t from the first. With `baseline` (bb) also aggregate_beyond: the subset's blocks that the baseline lacks."""
    u = maps.groupBy("map", "bb").agg(F.min("t").alias("t")).withColumn("inside", subset.cast("int"))
    known = baseline.select("bb").distinct().withColumn("known", F.lit(1)) if baseline is not None else None
    u = u.withColumn("beyond", F.col("inside")) if known is None else u.join(known, "bb", "left").withColumn("beyond", F.when(F.col("known").isNull(), F.col("inside")).otherwise(0)).drop("known")
    per_map = u.groupBy("map").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("current"), F.sum("inside").alias("current_subset"))
    # A block counts as new in the map that first has it, in the order of the maps.
    placed = u.select("map", "bb", "inside", "beyond").join(per_map.select("map", "t"), "map")
    first = placed.groupBy("bb", "inside", "beyond").agg(F.min(F.struct("t", "map")).alias("f"))
    new = first.groupBy(F.col("f.map").alias("map")).agg(F.count(F.lit(1)).alias("new"), F.sum("inside").alias("new_subset"), F.sum("beyond").alias("new_beyond"))
    up_to = Window.orderBy("t", "map").rowsBetween(Window.unboundedPreceding, 0)  # one row for each map
    rows = per_map.join(new, "map", "left").fillna(0, ["new", "new_subset", "new_beyond"])
    beyond = [] if known is None else [F.sum("new_beyond").over(up_to).alias("aggregate_beyond")]
    return rows.select("map", (F.col("t") - F.min("t").over(Window.partitionBy())).alias("t"), "current", "current_subset", F.sum("new").over(up_to).alias("aggregate"), F.sum("new_subset").over(up_to).alias("aggregate_subset"), *beyond)


def unknown_pcs(instructions: DataFrame, pcs: DataFrame) -> DataFrame:
    """By part: pcs, and those at which there is no instruction, from which no walk starts."""
    known = instructions.select("part", "addr").distinct().withColumn("known", F.lit(1))
    return pcs.select("part", "addr").join(known, ["part", "addr"], "left").groupBy("part").agg(F.count(F.lit(1)).alias("pcs"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"))


def composed_suite(tests: DataFrame, dropped: DataFrame) -> DataFrame:
    """Tests (map, command) whose map isn't dropped."""
    return tests.join(dropped.select("map"), "map", "left_anti")


def blocks_after_calls(instructions: DataFrame) -> DataFrame:
    """The instruction that follows each coverage call. `instructions` has part, addr, is_call, in the order of addr."""
    before = F.lag("is_call").over(Window.partitionBy("part").orderBy("addr"))
    return instructions.withColumn("after", before).where("after").select("part", "addr")


def block_of_line(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, line, start: the block with the greatest start up to the line, null before the first. `hits` has file and line, `blocks` file and start.

    Lines of both are put in one order per file, and the last start is carried forward by blocks of lines: no join on a range, no file in one task.
    """
    both = hits.select("file", "line", F.lit(False).alias("begins")).unionByName(blocks.select("file", F.col("start").alias("line"), F.lit(True).alias("begins"))).where("file is not null and line is not null")
    lines = both.groupBy("file", "line").agg(F.max("begins").alias("begins"))
    floors = running(lines, ["file"], "line", F.when(F.col("begins"), F.col("line")), "max", "start").select("file", "line", "start")
    return hits.select("file", "line").join(floors, ["file", "line"], "left")


def blocks_of_lines(hits: DataFrame, blocks: DataFrame, pattern: str) -> DataFrame:
    """file, line, block_file, block_start, found: the block of each hit, and how it was found.

    `blocks` has file, start and lines (array<struct<file, line>>: the source lines that it holds, of other files too). A hit is in the block of its file with the greatest start
    up to its line (found: start, where it is that line, or floor). Before the first start of its file, and where its file has no blocks but matches `pattern`, it is in the first block,
    by file and start, that holds its line (inside). Other hits, and those that no block holds, are in none (found is null).
    """
    at = block_of_line(hits, blocks)
    files = blocks.select("file").distinct().withColumn("known", F.lit(True))
    held = blocks.select(F.col("file").alias("block_file"), "start", F.explode("lines").alias("x")).groupBy(F.col("x.file").alias("file"), F.col("x.line").alias("line")).agg(F.min(F.struct("block_file", "start")).alias("holder"))
    both = at.join(files, "file", "left").join(held, ["file", "line"], "left")
    searched = F.col("start").isNull() & (F.coalesce("known", F.lit(False)) | F.col("file").rlike(pattern))
    how = F.when(F.col("start") == F.col("line"), "start").when(F.col("start").isNotNull(), "floor").when(searched & F.col("holder").isNotNull(), "inside")
    block_file = F.when(F.col("start").isNotNull(), F.col("file")).when(searched, F.col("holder.block_file"))
    block_start = F.coalesce("start", F.when(searched, F.col("holder.start")))
    return both.select("file", "line", block_file.alias("block_file"), block_start.alias("block_start"), how.alias("found"))


def lines_of_found(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, covered, total, percentage: lines of the found blocks among all lines that blocks hold, by the lines' files."""
    hit = found.where("found is not null").select(F.col("block_file").alias("file"), F.col("block_start").alias("start")).distinct().withColumn("hit", F.lit(1))
    each = blocks.join(hit, ["file", "start"], "left").select(F.explode("lines").alias("x"), "hit").groupBy("x.file", "x.line").agg(F.max("hit").alias("hit"))
    return each.groupBy("file").agg(F.count("hit").alias("covered"), F.count(F.lit(1)).alias("total")).withColumn("percentage", 100.0 * F.col("covered") / F.col("total"))


def directory(file: Column) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def line_coverage(lines: DataFrame, key: Column) -> DataFrame:
    """By key: distinct lines, covered ones and their share. `lines` has file, line, covered."""
    each = lines.groupBy(key.alias("name"), "file", "line").agg(F.max(F.col("covered").cast("int")).alias("covered"))
    sums = each.groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.sum("covered").alias("covered"))
    return sums.withColumn("percentage", F.try_divide(100.0 * F.col("covered"), F.col("lines")))


def covered_by_walks(instructions: DataFrame, pcs: DataFrame) -> DataFrame:
    """Distinct (file, line) of the instructions that a walk from some pc meets before the next stop, the stop's included.

    `instructions` has part, addr, file, line, is_stop. Each one belongs to the island that the next stop ends; a pc covers its island from itself on.
    The next stop is the running minimum from the end, one step a row. A part is one task; a binary has as many parts as functions.
    """
    ahead = F.min(F.when(F.col("is_stop"), F.col("addr"))).over(Window.partitionBy("part").orderBy(F.desc("addr")).rowsBetween(Window.unboundedPreceding, 0))
    islands = instructions.withColumn("island", F.coalesce(ahead, F.lit(-1)))
    from_ = islands.join(pcs.select("part", "addr"), ["part", "addr"], "left_semi").groupBy("part", "island").agg(F.min("addr").alias("first"))
    return islands.join(from_, ["part", "island"]).where("addr >= first").select("file", "line").distinct()


def share_covered(covered: DataFrame, coverable: DataFrame) -> DataFrame:
    """By file: coverable lines and covered ones among them."""
    all_lines = coverable.select("file", "line").distinct()
    hit = all_lines.join(covered.select("file", "line").distinct().withColumn("hit", F.lit(1)), ["file", "line"], "left")
    return hit.groupBy("file").agg(F.count(F.lit(1)).alias("coverable"), F.sum(F.coalesce("hit", F.lit(0))).alias("covered")).withColumn("percentage", 100.0 * F.col("covered") / F.col("coverable"))


def lcov_summary(lines: DataFrame, sums: bool = False, by_directory: bool = False, pattern: str | None = None, prefix: str = "") -> DataFrame:
    """By source file of lcov records, or by directory: name, lines, covered, percentage, functions, covered_functions, function_percentage.

    `lines` has source, n (its order) and value; records belong to the last SF before them. Lines are the distinct ones of DA records, or with `sums` what LF and LH records say, added up.
    A function is known by an FN or FNDA record, and covered by any execution; in a directory functions of one name are one. `prefix` is cut from files, those without it are left out; only names in which `pattern`
    is found are kept. A share of nothing is null for lines, and 0 for functions.
    """
    is_file = F.col("value").startswith("SF:")
    at = running(lines, ["source"], "n", F.when(is_file, F.struct("n", F.expr("substring(value, 4)").alias("file"))), "max", "last")
    r = at.select(F.col("last.file").alias("file"), "value").where(F.col("file").isNotNull() & F.col("file").startswith(prefix)).withColumn("file", F.expr(f"substring(file, {len(prefix) + 1})"))
    r = r.withColumns({"kind": F.substring_index("value", ":", 1), "rest": F.expr("substring(value, instr(value, ':') + 1)")}).withColumn("x", F.split("rest", ",", 2))
    name = directory(F.col("file")) if by_directory else F.col("file")
    number = lambda i: F.try_element_at("x", F.lit(i)).try_cast("long")
    if sums:
        counted = r.groupBy(name.alias("name")).agg(F.coalesce(F.sum(F.when(F.col("kind") == "LF", number(1))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("kind") == "LH", number(1))), F.lit(0)).alias("covered"))
    else:
        each = r.groupBy(name.alias("name"), "file", F.when(F.col("kind") == "DA", number(1)).alias("line")).agg(F.max(F.when(F.col("kind") == "DA", number(2))).alias("hits"))
        counted = each.groupBy("name").agg(F.count("line").alias("lines"), F.count(F.when(F.col("line").isNotNull() & (F.col("hits") > 0), 1)).alias("covered"))
    functions = r.where("kind in ('FN', 'FNDA')").groupBy(name.alias("name"), F.col("x")[1].alias("function")).agg(F.sum(F.when(F.col("kind") == "FNDA", number(1)).otherwise(0)).alias("hits"))
    of_name = functions.groupBy("name").agg(F.count(F.lit(1)).alias("functions"), F.count(F.when(F.col("hits") > 0, 1)).alias("covered_functions"))
    both = counted.join(of_name, "name", "left").fillna(0, ["functions", "covered_functions"])
    both = both.where(F.col("name").rlike(pattern)) if pattern else both
    share = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return both.select("name", "lines", "covered", share("covered", "lines").alias("percentage"), "functions", "covered_functions", F.coalesce(share("covered_functions", "functions"), F.lit(0.0)).alias("function_percentage"))


def curve_points(cells: DataFrame, side: int, curve: str = "hilbert") -> DataFrame:
    """x and y of each cell i on a square of a power of two: row by row (lines) or along a Hilbert curve, in bit arithmetic of columns."""
    if curve == "lines":
        return cells.withColumn("x", F.col("i") % side).withColumn("y", F.floor(F.col("i") / side))
    if curve == "spiral":
        # Ring r holds the cells (2r-1)^2 .. (2r+1)^2-1 around the middle.
        r = F.floor((F.sqrt("i") + 1) / 2).cast("long")
        k = F.col("i") - (2 * r - 1) * (2 * r - 1)
        leg, at = F.when(r == 0, 0).otherwise(F.floor(k / F.greatest(2 * r, F.lit(1)))), F.when(r == 0, 0).otherwise(k % F.greatest(2 * r, F.lit(1)))
        middle = side // 2
        x = F.when(leg == 0, r).when(leg == 1, r - 1 - at).when(leg == 2, -r).otherwise(-r + 1 + at)
        y = F.when(leg == 0, -r + 1 + at).when(leg == 1, r).when(leg == 2, r - 1 - at).otherwise(-r)
        return cells.withColumn("x", F.when(r == 0, 0).otherwise(x) + middle).withColumn("y", F.when(r == 0, 0).otherwise(y) + middle)
    out = cells.withColumn("x", F.lit(0).cast("long")).withColumn("y", F.lit(0).cast("long")).withColumn("d", F.col("i").cast("long"))
    s = 1
    while s < side:
        # Two bits of the distance choose a quadrant; the square so far is mirrored and turned to fit it.
        out = out.withColumn("rx", F.shiftright("d", 1).bitwiseAND(1)).withColumn("ry", F.col("d").bitwiseXOR(F.col("rx")).bitwiseAND(1))
        fx, fy = F.when(F.col("rx") == 1, s - 1 - F.col("x")).otherwise(F.col("x")), F.when(F.col("rx") == 1, s - 1 - F.col("y")).otherwise(F.col("y"))
        turn = F.col("ry") == 0
        out = out.withColumn("p", F.when(turn, F.struct(fy.alias("x"), fx.alias("y"))).otherwise(F.struct(F.col("x"), F.col("y"))))
        out = out.withColumn("x", F.col("p.x") + s * F.col("rx")).withColumn("y", F.col("p.y") + s * F.col("ry")).withColumn("d", F.shiftright("d", 2)).drop("p", "rx", "ry")
        s *= 2
    return out.drop("d")


def lines_of_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """basic_block, file, line of every input block that has source lines; a block that comes twice is converted twice. `blocks` has bb (hexadecimal), `lines` bb, file, line."""
    shown = F.concat(F.lit("0x"), F.regexp_replace(F.lower("bb"), "^(?:0x)?0*(?=.)", ""))
    return blocks.select("bb").join(lines, "bb").select(shown.alias("basic_block"), "file", "line")


def preprocessed(maps: DataFrame) -> DataFrame:
    """path, map (the file's name without folders), bb: the blocks of each map once. `maps` has path and bb."""
    return maps.select("path", F.substring_index("path", "/", -1).alias("map"), "bb").distinct()


#: Mnemonics of jumps, and the letters of operand sizes that may stand before or after a mnemonic.
JUMPS = ("jmp", "je", "jne", "jg", "jge", "ja", "jae", "jl", "jle", "jb", "jbe", "jo", "jno", "jz", "jnz", "js", "jns", "call", "loop", "loopcc", "loope", "loopne", "loopnz", "loopz", "ret", "iret")
SIZES = "bwlq"


def disassembled(lines: DataFrame) -> DataFrame:
    """source, address, number (from 0), is_jump of the instructions in the text of a disassembler, without those that do nothing.

    An instruction's line has its address in the first eight columns, a colon after it, and the mnemonic from column 33 on. `lines` has source, seq and value.
    """
    sized = lambda names: f"^[{SIZES}]?(?:{'|'.join(names)})[{SIZES}]?$"
    word = F.regexp_extract(F.substr("value", F.lit(33)), r"^ *([^ ]*)", 1)
    found = lines.where((F.length("value") > 32) & (F.substring("value", 9, 1) == ":")).withColumn("word", word).where(~F.col("word").rlike(sized(["nop"])))
    kept = found.select("source", "seq", F.substring("value", 1, 8).alias("address"), F.col("word").rlike(sized(JUMPS)).alias("is_jump"))
    return running(kept, ["source"], "seq", F.lit(1).cast("long"), "sum", "number", width=1 << 22).select("source", "address", (F.col("number") - 1).alias("number"), "is_jump")
