"""Many substring searches and many stored rules at once, through indexes that are joined by equality; rows never meet all terms or all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import by_merge

#: Letters of a gram; terms of fewer letters are looked up as they are.
GRAM = 3
#: Characters of all terms up to which terms with their grams are broadcast (a term counts TERM_COST more); beyond it the index is shuffled.
BROADCAST_CHARS, TERM_COST = 4 << 20, 100
#: Rules of a list, about.
IDS = 1000


def folded(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` letters of a text."""
    n = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def postings(rows: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """gram, ident: which rows have a run of one to GRAM letters in any of the columns, in lower case. Written once as a table, it serves every search."""
    every = F.array_distinct(F.flatten(F.array(*(grams(folded(F.col(c)), k) for c in columns for k in range(1, GRAM + 1)))))
    return rows.select(ident, F.explode(every).alias("gram"))


def search_all(rows: DataFrame, ident: str, columns: list[str], terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """term, ident of every row that has the term in any of the columns, in lower case.

    Terms (a table of term) are trimmed and in lower case; blank ones find nothing, repeated ones count once. The rarest gram of a
    term gives its candidates, which are then verified, so that only rows with that gram are looked at. A term of fewer than
    GRAM letters is a gram itself. `index` is what postings gave, if it is at hand. Terms are measured before they are broadcast; the index
    and the rows, whose size Spark can't tell before they are exploded, never are.
    """
    index = postings(rows, ident, columns) if index is None else index
    wanted = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    parts = wanted.select("term", F.explode(F.when(F.length("term") >= GRAM, grams(F.col("term"), GRAM)).otherwise(F.array("term"))).alias("gram"))
    few = (wanted.agg(F.sum(F.length("term") + TERM_COST)).first()[0] or 0) <= BROADCAST_CHARS
    sent = F.broadcast if few else by_merge
    # grams are counted in each task first, so that few rows move
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    found = parts.join(by_merge(sizes), "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = index.join(sent(found), "gram").select("term", ident)
    near = near.join(by_merge(rows.select(ident, *(folded(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)))), ident)
    hit = F.lit(False)
    for i in range(len(columns)):
        hit = hit | F.contains(f"_{i}", "term")
    return near.where(hit).select("term", ident)


def match_rules(rows: DataFrame, ident: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """ident, rule_id of every row that fulfils all enabled conditions of a rule.

    rules: rule_id and conditions, an array of (field, operator, value, enabled); the operators are equals and starts_with, as in
    filters.rule_matches. A null field is empty; a condition on a field that rows lack asks an empty text. Rows that are equal in
    all that rules ask for (a field that is only asked for its beginning: up to the longest) are one class, and so are rules with
    equal conditions; classes meet, and their pairs are dealt to rows and rules at the end, as the result itself. Each class of rules is
    looked up by one condition, the one that the fewest classes of rows fulfil, through its field and value (for starts_with: field,
    length and prefix); its other conditions are checked on what is found. Rules without an enabled condition, or whose conditions all
    hold of an empty text, match every row that lacks more; they are looked up by a key that every class holds.
    """
    at = lambda c: F.array_position(F.array(*map(F.lit, fields)), c["field"])
    on = F.transform(F.filter("conditions", lambda c: c["enabled"]), lambda c: F.struct(F.coalesce(at(c), F.lit(0)).cast("int").alias("at"), F.coalesce(c["operator"] == "equals", F.lit(False)).alias("equal"), F.coalesce(c["value"], F.lit("")).alias("value")))
    ruled = rules.select("rule_id", F.array_sort(F.array_distinct(on)).alias("asked"))
    kinds = ruled.select("asked").distinct()
    one = kinds.select("asked", F.explode("asked").alias("c")).select("asked", "c.*").where("at > 0")
    # one row a field at most, here and in lengths: the lengths of prefixes that rules ask for
    uses = {r.at: r for r in one.groupBy("at").agg(F.bool_or("equal").alias("equal"), F.max(F.length("value")).alias("most")).collect()}
    lengths = one.where("not equal").groupBy("at").agg(F.collect_set(F.length("value")).alias("lengths"))

    def told(i: int, f: str) -> Column:
        text = F.coalesce(F.col(f).cast("string"), F.lit(""))
        return F.lit("") if i not in uses else text if uses[i].equal else F.substring(text, 1, uses[i].most)

    classed = rows.select(ident, F.array(*(told(i, f) for i, f in enumerate(fields, 1))).alias("_values"))
    classes = classed.select("_values").distinct()
    cells = classes.select("_values", F.posexplode("_values").alias("at", "value")).withColumn("at", F.col("at") + 1).where(F.col("at").isin(*uses))
    starts = cells.join(F.broadcast(lengths), "at").select("_values", "at", F.lit(False).alias("equal"), F.explode(F.filter("lengths", lambda n: n <= F.length("value"))).alias("n"), "value").withColumn("value", F.substring(F.col("value"), F.lit(1), F.col("n"))).drop("n")
    every = classes.select("_values", F.lit(0).alias("at"), F.lit(True).alias("equal"), F.lit("").alias("value"))
    held = cells.withColumn("equal", F.lit(True)).unionByName(starts).unionByName(every)
    key = ["at", "equal", "value"]
    sizes = held.join(by_merge(one.select(*key).distinct()), key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    first = one.join(by_merge(sizes), key, "left").groupBy("asked").agg(F.min_by(F.struct(*key), F.struct(F.coalesce("n", F.lit(0)), *key)).alias("k")).select("asked", "k.*")
    loose = kinds.where(~F.exists("asked", lambda c: c["at"] > 0)).select("asked", F.lit(0).alias("at"), F.lit(True).alias("equal"), F.lit("").alias("value"))
    value = lambda c: F.coalesce(F.get("_values", c["at"] - 1), F.lit(""))
    holds = F.forall("asked", lambda c: F.when(c["equal"], value(c) == c["value"]).otherwise(F.startswith(value(c), c["value"])))
    pairs = first.unionByName(loose).join(by_merge(held), key).where(holds).select("asked", "_values")
    # the rules of a class in lists of some IDS, so that a row meets lists and not one rule after another
    lists = ruled.join(by_merge(ruled.groupBy("asked").agg(F.count("*").alias("n"))), "asked").groupBy("asked", F.pmod(F.xxhash64("rule_id"), F.ceil(F.col("n") / IDS)).alias("part")).agg(F.collect_list(F.struct("rule_id")).alias("ids"))
    met = pairs.join(by_merge(lists), "asked").select("_values", "ids")
    return classed.join(by_merge(met), "_values").select(ident, F.explode("ids").alias("r")).select(ident, "r.rule_id")
