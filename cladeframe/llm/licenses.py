"""License scan: ordered signature rules gated by keywords, nested detections resolved by precedence.

Text becomes words.  A document that has keywords of the rules shows a window of words around each of them, and the
rules of that keyword are matched there, so the work follows the keywords and not rules times text.  Of two
detections one of which lies inside the other's words the weaker goes: the one of the later level, else the shorter, else the one of the later
rule.  Everything is a DataFrame expression.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeframe.llm.common import free_name, stored, without
from cladeframe.llm.license_rules import REACH, RULES, SURE, Rule, anchored

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> Column:
    """A-Z in lower case; other letters may change too, but none of them into ASCII, so the words stay the same."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    for c in "Kİ":  # the only ones whose lower case has ASCII letters
        t = F.replace(t, F.lit(c), F.lit("à"))
    return F.lower(t)


def _rules(rules: list[Rule]) -> Column:
    """Map from keyword to its rules (number, marked pattern): a constant."""
    by: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        by.setdefault(r.keyword, []).append({"rule": k, "pattern": anchored(r)})
    return F.from_json(F.lit(json.dumps(by, ensure_ascii=False)), "map<string, array<struct<rule: int, pattern: string>>>")


def keywords(words: Column, rules: list[Rule]) -> Column:
    """The keywords that occur."""
    return F.array_intersect(words, F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})]))


def detections(words: Column, known: Column, rules: list[Rule]) -> Column:
    """Array of (rule, first, last) of all places where a rule's words stand, as places of their first and last word.

    ``known`` are the keywords among the words; both are columns, not expressions, as they are read for each word.  A rule is met at most once for
    each place of its keyword, as its pattern has the keyword in one marked place.
    """
    table = _rules(rules)
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(known, w), i)), lambda i: i.isNotNull())

    def window(i: Column) -> Column:
        at = F.array(F.concat(F.lit("="), words[i]))
        before, after = F.slice(words, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), F.slice(words, i + 2, F.lit(REACH))
        shown = F.concat(F.lit(" "), F.array_join(F.concat(before, at, after), " "), F.lit(" "))
        return F.struct(i.alias("i"), words[i].alias("keyword"), shown.alias("shown"))

    def spaces(t: Column) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))

    def place(hit: Column, met: Column) -> Column:
        first = hit["i"] - spaces(F.substring_index(met["m"], "=", 1))
        return F.struct(met["rule"].alias("rule"), first.alias("first"), (first + spaces(met["m"])).alias("last"))

    def met(hit: Column) -> Column:
        tried = F.transform(table[hit["keyword"]], lambda r: F.struct(r["rule"].alias("rule"), F.call_function("regexp_extract", hit["shown"], r["pattern"], F.lit(0)).alias("m")))
        return F.transform(F.filter(tried, lambda m: m["m"] != ""), lambda m: place(hit, m))

    none = F.array().cast("array<struct<rule: int, first: int, last: int>>")
    return F.when(F.size(known) > 0, F.flatten(F.transform(F.transform(places, window), met))).otherwise(none)


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """All columns but the text and clashing ones, with ``n_words``, ``n_base`` (places of base rules), ``first_word`` and
    ``last_word`` (smallest and largest start of such a place, else null), ``base_labels``, ``labels`` (those and the labels of
    detections that no better one nests with) and ``score``: how sure the best detection's level is, 0 without one.

    Null counts as empty; empty texts have no words and empty labels.  Every row is judged by itself, so repeated rows and keys come
    out as often as they come in.  Texts are read once; only detections are shuffled.
    """
    docs = without(docs, [c for c in RESULTS if c != text])
    row = free_name(docs, "row")
    others = [f"`{c}`" for c in docs.columns if c != text]
    words = docs.select(*others, F.monotonically_increasing_id().alias(row), F.array_remove(F.split(lowered(text), BREAK), "").alias("words"))
    words = words.withColumn("known", keywords(F.col("words"), rules))
    found = words.select(F.col(row), F.struct(*others).alias("doc") if others else F.lit(None).cast("int").alias("doc"), F.size("words").cast("bigint").alias("n_words"), detections(F.col("words"), F.col("known"), rules).alias("found"))
    found = stored(found, "licenses")
    const = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    of = lambda values, kind: F.element_at(const(values, kind), F.col("d.rule") + 1)
    each = found.select(row, F.explode("found").alias("d")).select(
        row, "d.*", of([r.label for r in rules], "string").alias("label"), of([r.level for r in rules], "int").alias("level"), of([r.base for r in rules], "boolean").alias("base"))
    levels = sorted(SURE)
    onward = Window.partitionBy(row).orderBy(F.asc("first"), F.desc("last"), F.asc("level"), F.asc("rule")).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(row).orderBy(F.desc("first"), F.asc("last"), F.desc("level"), F.desc("rule")).rowsBetween(Window.unboundedPreceding, -1)
    around, within = F.lit(False), F.lit(False)
    for n in levels:  # those around come before in the first order, those within come before in the second
        around |= (F.col("level") == n) & (F.max(F.when(F.col("level") <= n, F.col("last"))).over(onward) >= F.col("last"))
        within |= (F.col("level") == n) & (F.min(F.when(F.col("level") < n, F.col("last"))).over(backward) <= F.col("last"))
    judged = each.withColumn("weaker", F.coalesce(around, F.lit(False)) | F.coalesce(within, F.lit(False)))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    sure = F.element_at(const([SURE[n] for n in levels], "double"), F.min(F.array_position(const(levels, "int"), F.col("level"))).cast("int"))
    per = judged.groupBy(row).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("base") | ~F.col("weaker")).alias("labels"), sure.alias("score"))
    out = found.select(row, "doc", "n_words").join(per, row, "left")
    filled = [F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score")]
    return out.select(*(["doc.*"] if others else []), "n_words", *filled)
