"""Line dedup by a segment-partition edit join, by DataFrame functions alone.

A line goes if an earlier line of the corpus (by doc_id, then position) is equal or within a threshold of edits, which may grow with
the length of the shorter line. Exact repeats are found by a hash of the line. For near ones, a line of a class of lengths has
threshold-plus-one segments whose places depend on the class alone: the first half of them count from its start, the others from its
end. Of two lines within the threshold some segment i is whole in both, with at most i edits before it and at most threshold - i
behind, so a longer line finds it at one of 2 * min(i, threshold - i) + 1 places. Candidates are verified by a banded bit-parallel
edit distance.

Lines of a segment that many share meet inside a join that lets near pairs out only. Where too many share it, they are compared with the
earliest of them; those that are
still open are split further by the same join of what is left of the line without the segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Shorter lines say too little to be near copies of another unless asked for otherwise (`near_least`); only exact repeats of them go.
MIN_CHARS = 32
#: Lines of a segment up to which all its pairs are handed on; those of larger ones meet inside a join that lets near pairs out only.
HOT = 32
#: Rows up to which a side (16 bytes a row or so) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Lines of a hot segment up to which they meet one another, so that a row meets so many at most; a larger segment is split once more.
WORTH = 2000
#: Pairs of a hot segment that one part of the join looks at.
PART_PAIRS = 200_000

#: The largest threshold, as a band is to fit one long.
MOST_EDITS = 29
#: Letters whose counts tell most lines apart before their edit distance is asked for.
LETTERS = "etaoinsrhldu"

Edits = Callable[[Column], Column]


def one_edit(size: Column) -> Column:
    return F.lit(1)


def grown(size: Column) -> Column:
    """A threshold that grows with the length of the shorter line: one edit at 32 characters, one more at every doubling."""
    return F.length(F.bin(size.cast("long"))) - 5


def other_words(size: Column) -> Column:
    """A threshold on words: one of five or more, one more at every sixteen words; none of fewer."""
    return F.when(size < 5, 0).otherwise(F.least(F.lit(MOST_EDITS), 1 + F.floor(size / 16).cast("int")))


def coded(line: Column) -> Column:
    """One character for each word of a line, blanks parting words: equal words have equal ones, and few others share them."""
    return F.decode(F.unhex(F.array_join(F.transform(F.split(line, " ", -1), lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(0xC000)) + 0x1000)), "")), "UTF-16BE")


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within_edits(x: Column, y: Column, edits: Column | int, by_words: bool = False) -> Column:
    """Whether the edit distance of two strings, or that of their words, is at most `edits`, which is MOST_EDITS at most.

    Bit i of a vector stands for row j - edits + i of column j, so that the band moves down one row a column and fits one long.
    vp and vn say where a row is one more or one less than the row before it; the distance is followed along the band's lower
    rim until that meets the last row, and then along that row.
    """
    edits = F.lit(edits) if isinstance(edits, int) else edits
    length = (lambda v: F.size(F.split(v, " ", -1))) if by_words else F.length
    units = (lambda v: F.split(v, " ", -1)) if by_words else (lambda v: F.slice(F.split(v, ""), F.lit(1), F.length(v)))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    left = lambda v, n: F.call_function("shiftleft", v, n)
    right = lambda v, n: F.call_function("shiftright", v, n)
    both = lambda *v: v[0] if len(v) == 1 else v[0].bitwiseAND(both(*v[1:]))
    either = lambda *v: v[0] if len(v) == 1 else v[0].bitwiseOR(either(*v[1:]))
    given = F.struct(
        units(x).alias("x"), units(y).alias("y"), length(x).alias("n"), length(y).alias("m"), edits.cast("int").alias("t"),
        F.sequence(F.lit(0), 2 * edits.cast("int")).alias("rows"), (left(one, 2 * edits.cast("int") + 1) - 1).alias("full"),
    )

    def distance(g: Column) -> Column:
        t, full = g["t"], g["full"]

        def mask(c: Column, j: Column) -> Column:
            return F.aggregate(g["rows"], zero, lambda acc, i: F.when((j - t + i < g["n"]) & (F.get(g["x"], j - t + i) == c), acc.bitwiseOR(left(one, i))).otherwise(acc))

        def step(acc: Column, m: Column) -> Column:
            vp, vn, at = acc["vp"], acc["vn"], g["n"] - acc["j"] + t - 1

            def rest(d: Column) -> Column:
                d0, hn = d["d0"], both(d["d0"], vp)
                hp = both(full, either(vn, F.bitwise_not(either(d0, vp))))
                down = right(d0, F.lit(1))
                bit = lambda v: both(right(v, at), one)
                move = F.when(at >= 2 * t, one - right(d0, 2 * t)).otherwise(bit(hp) - bit(hn))
                return F.struct(both(full, either(hn, F.bitwise_not(either(down, hp)))).alias("vp"), both(down, hp).alias("vn"), (acc["dist"] + move).alias("dist"), (acc["j"] + 1).alias("j"))

            d0 = both(full, either((both(m, vp) + vp).bitwiseXOR(vp), m, vn))
            return bound(F.struct(d0.alias("d0")), rest)

        start = F.struct((full - left(one, t) + 1).alias("vp"), zero.alias("vn"), F.least(t, g["n"]).cast("long").alias("dist"), F.lit(0).alias("j"))
        return F.aggregate(F.transform(g["y"], mask), start, step)["dist"]

    return F.when(F.abs(length(x) - length(y)) > edits, F.lit(False)).when(x == y, F.lit(True)).otherwise(bound(given, distance) <= edits)


def cores(x: Column, y: Column) -> Column:
    """struct(x, y) of what is left of two strings without most of their common prefix and suffix, which are found by halving steps."""

    def common(a: Column, b: Column) -> Column:
        least = F.least(F.length(a), F.length(b))
        same = lambda at, n: (F.substring(a, at + 1, n) == F.substring(b, at + 1, n))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.call_function("shiftright", least, k)), F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))

    def tails(g: Column) -> Column:
        cut = lambda v: F.reverse(F.substring(v, g["p"] + 1, F.length(v)))
        return bound(F.struct(cut(g["x"]).alias("x"), cut(g["y"]).alias("y")), heads)

    def heads(g: Column) -> Column:
        return bound(F.struct(g["x"].alias("x"), g["y"].alias("y"), common(g["x"], g["y"]).alias("p")), lambda h: F.struct(*(F.substring(h[c], h["p"] + 1, F.length(h[c])).alias(c) for c in ("x", "y"))))

    return bound(F.struct(x.alias("x"), y.alias("y"), common(x, y).alias("p")), tails)


def reaches_end(x: Column, y: Column, edits: Column) -> Column:
    """Whether y can be reached from x within `edits` steps, by how far each of the 2 * edits + 1 diagonals comes with every step more.

    Equal stretches are found by powers of two, so a pair that differs in a few words costs steps, not characters. It says the same
    as within_edits and comes before it, as most pairs of a hot segment are near misses.
    """
    nowhere = F.lit(-(1 << 30))

    def equal(g: Column, r: Column, d: Column) -> Column:
        """How far x from r on equals y from r + d on."""
        least = F.least(g["n"] - r, g["m"] - r - d)
        steps = F.transform(F.sequence(F.length(F.bin(least.cast("long"))) - 1, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
        same = lambda at, n: (at + n <= least) & (F.substring(g["x"], r + at + 1, n) == F.substring(g["y"], r + d + at + 1, n))
        return F.when(least > 0, F.aggregate(steps, F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))).otherwise(0)

    def slid(g: Column, r: Column, d: Column) -> Column:
        return bound(F.least(r, g["n"], g["m"] - d), lambda r: F.when((r >= 0) & (r + d >= 0), r + equal(g, r, d)).otherwise(nowhere))

    def walk(g: Column) -> Column:
        t = g["t"]
        step = lambda rows: F.transform(g["diagonals"], lambda d, k: slid(g, F.greatest(F.get(rows, k) + 1, F.coalesce(F.get(rows, k - 1), nowhere), F.coalesce(F.get(rows, k + 1), nowhere) + 1), d))
        start = F.transform(g["diagonals"], lambda d: F.when(d == 0, equal(g, F.lit(0), d)).otherwise(nowhere))
        return F.get(F.aggregate(F.slice(F.sequence(F.lit(0), t), F.lit(2), t), start, lambda rows, _: step(rows)), g["m"] - g["n"] + t) >= g["n"]

    given = F.struct(x.alias("x"), y.alias("y"), F.length(x).alias("n"), F.length(y).alias("m"), edits.cast("int").alias("t"), F.sequence(-edits.cast("int"), edits.cast("int")).alias("diagonals"))
    return F.when(F.abs(F.length(x) - F.length(y)) > edits, F.lit(False)).otherwise(bound(given, walk))


def letter_counts(line: Column) -> Column:
    return F.struct(*((F.length(line) - F.length(F.translate(line, c, ""))).alias(f"n_{c}") for c in LETTERS))


def apart(a: Column, b: Column) -> Column:
    """Sum of the differences of letter counts."""
    out = F.lit(0)
    for c in LETTERS:
        out = out + F.abs(a[f"n_{c}"] - b[f"n_{c}"])
    return out


def lines_of(docs: DataFrame, least: int = 1) -> DataFrame:
    """at (doc_id, hash of the text, pos from 0) and line of every line of `least` characters or more of rows that have an id."""
    every = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return every.where(F.length("line") >= least).select(F.struct("doc_id", "text_hash", "pos").alias("at"), "line")


def first_lines(docs: DataFrame, least: int, near_least: int) -> DataFrame:
    """id, at, size and line of the earliest place of every distinct line of `least` characters or more. Stored.

    A distinct line is told by 128 bits of hash and its length; lines too short to be near copies come without their text.
    """
    line, n = F.col("line"), F.length("line")
    rows = lines_of(docs, least).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), n.alias("size"), F.struct("at", F.when(n >= near_least, line).alias("line")).alias("it"))
    first = rows.groupBy("h1", "h2", "size").agg(F.min("it").alias("it"))
    return stored(first.select(F.monotonically_increasing_id().alias("id"), "it.at", "size", "it.line"), "lines")


def class_width(size: Column) -> Column:
    """How many lengths the class of a length has: a quarter of its leading binary digit."""
    lead = F.floor(F.log2(size + 0.5)).cast("int")
    return F.call_function("shiftleft", F.lit(1), F.greatest(lead - 2, F.lit(0)))


def class_of(size: Column) -> Column:
    """The least length of the class of a length."""
    return size - size % class_width(size)


def classes(size: Column, edits: Column) -> Column:
    """Array of the classes of lengths from size - edits to size: one or two, as edits are a ninth of the size at most."""
    return F.array_distinct(F.array(class_of(size), class_of(size - edits.cast("int"))))


def places(spark: SparkSession) -> DataFrame:
    """edits, ahead, j, shift: where a string may have each segment, for every threshold up to MOST_EDITS; a literal table of about 5,000 rows.

    Segment j from the start (ahead) or from the end may be moved by j places at most.
    """
    rows = [(t, ahead, j, d) for t in range(MOST_EDITS + 1) for ahead, n in ((True, t // 2 + 1), (False, t - t // 2)) for j in range(n) for d in range(-j, j + 1)]
    return spark.createDataFrame(rows, "edits int, ahead boolean, j int, shift int")


def cut_up(rows: DataFrame, every: bool = True) -> DataFrame:
    """rows (string s of n characters, base, edits, own, salt and others) times the segments that s may have of the class of base: key, start and len besides.

    own: whether s is of the class itself, so that its segments at their own place are what others look for; without `every` only those
    are given.
    """
    where = places(rows.sparkSession)
    if not every:
        rows, where = rows.where("own"), where.where("shift = 0")
    rows = rows.join(F.broadcast(where), "edits").withColumn("len", F.floor(F.col("base") / (F.col("edits") + 1)).cast("int"))
    start = F.when(F.col("ahead"), F.col("j") * F.col("len")).otherwise(F.col("n") - (F.col("j") + 1) * F.col("len")) + F.col("shift")
    rows = rows.withColumn("start", start).where("start >= 0 and start + len <= n")
    key = F.xxhash64("salt", "base", "ahead", "j", F.substring("s", F.col("start") + 1, F.col("len")))
    return rows.withColumn("key", key).withColumn("own", F.col("own") & (F.col("shift") == 0)).drop("ahead", "j", "shift", "salt")


def near_lines(lines: DataFrame, edits: Edits, near_least: int, by_words: bool = False) -> DataFrame:
    """id: distinct lines of near_least characters or more that have such an earlier line within edits(length of the shorter). Stored.

    by_words: lengths and edits count words. Candidates are then found by one character for each word, which loses no pair, and
    verified on the words themselves.
    """
    texts = lines.where(F.col("size") >= near_least)
    size, base = F.col("size"), F.col("base")
    unit, kept = ("code", ["line", "code"]) if by_words else ("line", ["line"])
    if by_words:
        texts = texts.withColumn("code", coded(F.col("line"))).withColumn("size", F.length("code")).where(edits(size) > 0)
    spread = texts.withColumn("base", F.explode(classes(size, edits(size)))).withColumn("own", base == class_of(size))
    # thresholds never fall with length, so the longest of a class has the largest
    spread = spread.withColumn("edits", edits(base + class_width(base) - 1).cast("int")).withColumn("salt", F.lit(0)).withColumn("n", size).withColumn("s", F.col(unit)).drop(*kept)
    rows = cut_up(spread)
    short = lambda x, y: edits(F.least(x, y)).cast("int")

    def near(x: Column, y: Column, most: Column) -> Column:
        told = bound(F.struct(cores(x[unit], y[unit]).alias("c"), most.alias("most")), lambda g: reaches_end(g["c"]["x"], g["c"]["y"], g["most"]) & (F.lit(True) if by_words else within_edits(g["c"]["x"], g["c"]["y"], g["most"])))
        return told & within_edits(x["line"], y["line"], most, True) if by_words else told

    def verified(pairs: DataFrame) -> DataFrame:
        """id of the later line of each pair (a, b) of ids that is near."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = stored(texts.join(sized(ids, 2 * pairs.count()), "id", "left_semi").select("id", "at", *kept, letter_counts(F.col(unit)).alias("letters")), "texts")
        side = lambda c: wanted.select(F.col("id").alias(c), F.struct("at", *kept, "letters").alias(f"at_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        x, y = F.col("at_a"), F.col("at_b")
        most = short(F.length(x[unit]), F.length(y[unit]))
        # an edit changes two counts by one at most, so few pairs need the whole distance; these are spread over all tasks, small as they are
        both = both.where(apart(F.col("at_a.letters"), F.col("at_b.letters")) <= 2 * most).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        later = both.where(near(x, y, most)).select(F.when(F.col("at_a.at") > F.col("at_b.at"), F.col("a")).otherwise(F.col("b")).alias("id"))
        out = stored(later.distinct(), "near")
        discard(pairs, wanted)
        return out

    def paired(own: DataFrame, every: DataFrame) -> DataFrame:
        """Pairs (a, b) of ids that share a key of few lines, b not the shorter."""
        side = lambda df, c: df.select("key", *(F.col(x).alias(f"{x}_{c}") for x in ("id", "size")))
        pairs = side(own, "a").join(side(every, "b"), "key").where((F.col("id_a") != F.col("id_b")) & (F.col("size_b") >= F.col("size_a")) & (F.col("size_b") - F.col("size_a") <= short(F.col("size_a"), F.col("size_a"))))
        return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    def met(rows: DataFrame) -> DataFrame:
        """id of the later line of each near pair that shares a key of rows, told inside the join, so that no other pair comes out of it.

        A key's pairs are dealt over parts: all its own lines go to each part, and each line that meets them to one. A pair with several
        keys is told at the least of them only.
        """
        rows = stored(rows.groupBy("key", "id").agg(F.max("own").alias("own")), "met")
        parts = stored(rows.groupBy("key").agg(F.ceil(F.count_if("own") * F.count("*") / PART_PAIRS).cast("int").alias("parts")), "parts")
        keys = rows.groupBy("id").agg(F.collect_set(F.when(F.col("own"), F.col("key"))).alias("own_keys"), F.collect_set("key").alias("keys"))
        info = stored(texts.join(keys, "id").select("id", F.struct("at", *kept, "size", letter_counts(F.col(unit)).alias("letters"), "own_keys", "keys").alias("it")), "met-texts")
        dealt = rows.join(sized(parts, parts.count()), "key").where("parts > 0").join(info, "id")
        own = dealt.where("own").select("key", F.col("id").alias("a"), F.col("it").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        every = dealt.select("key", F.col("id").alias("b"), F.col("it").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        x, y = F.col("x"), F.col("y")
        most = short(x["size"], x["size"])
        cheap = (F.col("a") != F.col("b")) & ((y["size"] > x["size"]) | ((y["size"] == x["size"]) & (F.col("a") < F.col("b")))) & (y["size"] - x["size"] <= most) & (apart(x["letters"], y["letters"]) <= 2 * most)
        first = F.col("key") == F.array_min(F.array_intersect(x["own_keys"], y["keys"]))
        pairs = own.join(every, ["key", "part"]).where(cheap & first & near(x, y, most))
        out = stored(pairs.select(F.when(x["at"] > y["at"], F.col("a")).otherwise(F.col("b")).alias("id")).distinct(), "near")
        discard(rows, parts, info)
        return out

    def busy(uncut: DataFrame) -> tuple[DataFrame, int]:
        hot = stored(cut_up(uncut, every=False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot-keys")
        return hot, hot.count()

    def without(rows: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
        return rows.join(sized(hot, n_hot), "key", "left_anti") if n_hot else rows

    def detailed(cut: DataFrame) -> DataFrame:
        rest = F.concat(F.substring("s", F.lit(1), F.col("start")), F.substring("s", F.col("start") + F.col("len") + 1, F.col("n")))
        return cut.select("key", "id", "at", "size", "own", rest.alias("s"), (F.col("n") - F.col("len")).alias("n"), "edits", (F.col("base") - F.col("len")).alias("base"))

    hot, n_hot = busy(spread)
    cool = without(rows.select("key", "id", "size", "own"), hot, n_hot)
    found = verified(paired(cool.where("own"), cool))
    if n_hot:
        rows = stored(detailed(rows.join(sized(hot, n_hot), "key", "left_semi")), "hot")
    while n_hot:
        # each key by itself: the lines of a small one meet one another; a larger one is split once more, unless nothing is left to split
        sizes = stored(rows.groupBy("key").agg(F.count_if("own").alias("n"), F.max("base").alias("base"), F.max("edits").alias("edits")).select("key", ((F.col("n") <= WORTH) | (F.col("base") <= F.col("edits"))).alias("small")), "sizes")
        n_small, n_keys = sizes.agg(F.count_if("small"), F.count("*")).first()
        if n_small:
            small = rows.join(sized(sizes.where("small"), n_small), "key", "left_semi") if n_small < n_keys else rows
            found = stored(found.unionByName(met(small)).distinct(), "near")
        if n_small == n_keys:
            break
        if n_small:
            rows = rows.join(sized(sizes.where("small"), n_small), "key", "left_anti")
        least = rows.groupBy("key").agg(F.min(F.struct("at", "id")).alias("least"))
        found = stored(found.unionByName(verified(rows.join(least, "key").where("id <> least.id").select(F.col("id").alias("a"), F.col("least.id").alias("b")))).distinct(), "near")
        # of lines that have no earlier one yet, and are not the first of their group, all earlier ones of the group are to be seen
        unmet = rows.join(found, "id", "left_anti").join(least, "key").where("id <> least.id")
        last = stored(unmet.groupBy("key").agg(F.max("at").alias("last")), "open")
        n_open = last.count()
        if not n_open:
            break
        uncut = rows.join(sized(last, n_open), "key").where("at <= last").drop("last").withColumnRenamed("key", "salt")
        cut = cut_up(uncut)
        hot, n_hot = busy(uncut)
        cool = without(cut.select("key", "id", "size", "own"), hot, n_hot)
        found = stored(found.unionByName(verified(paired(cool.where("own"), cool))).distinct(), "near")
        if n_hot:
            rows = stored(detailed(cut.join(sized(hot, n_hot), "key", "left_semi")), "hot")
            discard(sizes, last)
    return found


def dedup_lines(docs: DataFrame, edits: Edits = one_edit, least: int = 1, near_least: int | None = None, words: Edits | None = None) -> DataFrame:
    """All columns of docs with its text cut to the lines that stay, and n_lines, n_dropped (long) of each row.

    Lines are parts between line feeds. A line of `least` characters or more goes if an earlier line of the corpus is equal; one of
    near_least (MIN_CHARS unless given) characters or more also if an earlier one of that length is within edits(length of the shorter), a threshold that
    must not fall with length, and be a ninth of it and MOST_EDITS at most. With `words`, a line also goes if an earlier one of near_least
    characters is within words(words of the shorter) other, more or fewer words: one, or an eighth of them, and MOST_EDITS at most. Empty lines, and rows without an id, stay as they are. A null text stays null with 0 lines, an empty one is one
    empty line. Rows that repeat an id with another text are documents of their own, in an order by a hash of the text; rows that repeat
    both count as one document, whose rows all keep what it keeps. Columns called n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    near_least = MIN_CHARS if near_least is None else near_least
    lines = first_lines(docs.select("doc_id", "text"), least, near_least)
    near = near_lines(lines, edits, near_least)
    if words:
        near = near.unionByName(near_lines(lines, words, near_least, True)).distinct()
    kept = lines.join(near, "id", "left_anti").groupBy("at.doc_id", "at.text_hash").agg(F.collect_set("at.pos").alias("_kept"))
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    # one column of others, so that none of their names can clash
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"), F.struct(F.lit(0), *other).alias("other")).join(kept, ["doc_id", "text_hash"], "left")
    small = F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) < least, i)), lambda i: i.isNotNull())
    stay = F.transform(F.array_sort(F.concat(small, F.coalesce("_kept", F.array().cast("array<int>")))), lambda i: F.get("lines", i))
    split = split.withColumn("left", F.when(F.col("doc_id").isNull(), F.col("lines")).otherwise(stay))
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    column = {"doc_id": F.col("doc_id"), "text": F.array_join("left", "\n").alias("text")}
    return split.select(*(column.get(c, F.col("other")[c].alias(c)) for c in docs.columns), count("lines").alias("n_lines"), (count("lines") - count("left")).alias("n_dropped"))


def op1_line_dedup(spark, sf_dir):
    """Exact repeats of every line that is not empty, and lines of 32 characters or more at one edit."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_line_dedup_words(spark, sf_dir):
    """Exact repeats of every line that is not empty, and lines of 32 characters or more at one edit, or at as many words as other_words allows."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), words=other_words)


#: Of two lines within one edit and of 32 characters or more, the first or the last 15 characters agree; that finds the candidates.
OP1_SQL = """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s WHERE text IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM l WHERE line <> ''),
f AS (SELECT line, doc_id, pos, length(line) AS size, left(line, 15) AS head, right(line, 15) AS tail FROM e WHERE n = 1 AND length(line) >= 32),
c AS (
  SELECT a.line AS x, b.line AS y FROM f a JOIN f b ON a.head = b.head AND abs(a.size - b.size) <= 1 AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))
  UNION
  SELECT a.line, b.line FROM f a JOIN f b ON a.tail = b.tail AND abs(a.size - b.size) <= 1 AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))
), near AS (
  SELECT DISTINCT x AS line FROM c
  WHERE len(list_filter(range(0, greatest(length(x), length(y))), lambda i: left(x, i) = left(y, i) AND
    substr(x, i + CASE WHEN length(x) >= length(y) THEN 2 ELSE 1 END) = substr(y, i + CASE WHEN length(y) >= length(x) THEN 2 ELSE 1 END))) > 0
), gone AS (SELECT e.doc_id, e.pos FROM e LEFT JOIN near USING (line) WHERE e.n > 1 OR near.line IS NOT NULL),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM s LEFT JOIN k ON k.doc_id = s.doc_id
"""
