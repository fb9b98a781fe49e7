"""Mapping of freely typed values to a canonical list by token repair and soft TF-IDF.

Each distinct token of the values is joined to the vocabulary of the list: exactly, by edit distance (a join on shared deletions), as an
abbreviation (a token whose letters occur in a word in order, a join on three of them, or that begins a word), glued to its neighbour or torn in two. The
repaired tokens then meet the entries, which are ranked by how much of the entry's weight the value covers and how much of the value's weight the
entry covers. The best is that of all entries: those whose first word or symbol is met are all ranked; of the others those that may cover the value
whole, found by the value's rarest words; and where what is left out might still be better than the best so far, all the rest. Values whose best
entry stays below a threshold are reported as not in the list.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.session import checkpointed, partitions

_MARKED = [(chr(i), d[0]) for i in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(i)))[0] != chr(i) and d[0].isascii()]
#: Legal forms, which values add, drop and exchange; they count little.
LEGAL = ("inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "plc", "nv", "lp", "holdings", "group", "partners", "sa", "ag", "the", "due", "of", "and")
#: What forms put around a name, removed before it is read (owner codes, verbs, options, notes, prices).
AROUND = (
    r"^\W*(sp|jt|dc|s|j)\b\W+(?=\w{3})", r"^\W*(sold|buy|sell|bought|purchase|sale)( of)?\b\W*", r"\b(call|put)s?\b( option.*| \d.*|\W*$).*$", r"\boption\b.*$",
    r"\bvia .*$", r"\(?see .*$", r"\W*\bamended\W*$", r"@\s*[\d.,]+", r"\[(st|et|mf|gs|cs)\]",
)
#: No word weighs more than one that this many entries of two thousand share, else a rare first word outweighs all others.
HEAVIEST = 4.6
#: A word that so many entries share is a general one, which may be abbreviated within.
GENERAL = 5
#: Likeness from which a token likely stands for a term.
STRONG = 0.7
#: An entry none of whose anchors is met, and which covers less than this share of the value's weight, is another one and counts by `OTHER`, as does one of another class, rate or year.
WHOLE = 0.9
OTHER = 0.3
#: Bounds are widened by so much, more than sums of floats err.
SLACK = 1e-7
#: What tells entries apart whole: share class, rate, year.
SLOTS = ("class", "rate", "year")


def plain(c: Column) -> Column:
    """Letters without marks, in lower case."""
    kept = F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.lower(F.regexp_replace(kept, r"\p{M}+", ""))


def words(c: Column) -> Column:
    """The tokens of a value: words, numbers, percentages, years of dates, and share classes as class:x."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}]+", " "), r"(\p{Ll}{3})(\p{Lu}\p{Ll}{2})", "$1 $2")
    s = plain(s)
    for noise in AROUND:
        s = F.trim(F.regexp_replace(s, noise, " "))
    s = F.regexp_replace(s, r"\b([a-z])\.\s?([a-z])\.(?![a-z])", "$1$2 ")
    s = F.regexp_replace(s, r"\b\d{1,2}/\d{1,2}/(\d{4})\b", " $1 ")
    s = F.regexp_replace(s, r"\b(?:class|cl|cls)\b\.?\s*([a-z])\b", " class:$1 ")
    return F.coalesce(F.regexp_extract_all(s, F.lit(r"((?:class:)?[a-z0-9]+(?:\.[a-z0-9]+)*%?)"), 1), F.array().cast("array<string>"))


def is_slot(t: Column) -> Column:
    """Tokens that tell entries apart whole and are never repaired: rates, numbers, share classes."""
    return t.rlike(r"^(\d+(\.\d+)?%?|class:.)$")


def slot_kind(t: Column) -> Column:
    return F.when(t.startswith("class:"), "class").when(t.endswith("%"), "rate").when(t.rlike(r"^20\d\d$"), "year")


def deletions(t: Column, two: Column) -> Column:
    """t and what is left of it after one deletion, after two where `two` holds."""

    def once(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    one = once(t)
    return F.array_distinct(F.concat(F.array(t), one, F.when(two, F.flatten(F.transform(one, once))).otherwise(F.array().cast("array<string>"))))


def _reach(t: Column) -> Column:
    """Edits that a token of this length may have."""
    return F.when(F.length(t) >= 6, 2).when(F.length(t) >= 4, 1).otherwise(0)


def reference_terms(reference: DataFrame, entry_id: str, name: str, symbols: list[str]) -> DataFrame:
    """(entry, term, kind, df, weight, anchor) for each distinct term of each entry; kind is name, legal, slot or symbol.

    The anchors are the first word, which says whose entry it is, and the symbols.
    """
    listed = reference.select(F.col(entry_id).cast("long").alias("entry"), F.array_distinct(words(F.col(name))).alias("ts"), *[F.lower(F.trim(F.col(s))).alias(f"s{i}") for i, s in enumerate(symbols)])
    named = listed.select("entry", F.posexplode("ts").alias("at", "term")).select("entry", "term", F.lit(False).alias("symbol"), (F.col("at") == 0).alias("lead"))
    if symbols:
        coded = listed.select("entry", F.explode(F.array(*[f"s{i}" for i in range(len(symbols))])).alias("term")).where("term <> ''").distinct()
        named = named.unionByName(coded.select("entry", "term", F.lit(True).alias("symbol"), F.lit(False).alias("lead")))
    sizes = named.groupBy("term", "symbol").agg(F.count(F.lit(1)).alias("df"))
    n = reference.agg(F.count(F.lit(1)).alias("n"))
    t = named.join(spread(sizes), ["term", "symbol"]).crossJoin(F.broadcast(n))  # one row
    kind = F.when(F.col("symbol"), "symbol").when(is_slot(F.col("term")), "slot").when(F.col("term").isin(*LEGAL), "legal").otherwise("name")
    t = t.withColumn("kind", kind).withColumn("weight", F.least(F.log1p(F.col("n") / F.col("df")), F.lit(HEAVIEST)) * F.when(F.col("kind") == "legal", 0.15).when(F.col("kind") == "slot", 0.8).otherwise(1.0))
    return t.select("entry", "term", "kind", "df", "weight", (F.col("lead") | F.col("symbol")).alias("anchor"))


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: what rows explode to is far more than the estimates say, and the smallest broadcast by a text takes 17 MB of the driver."""
    return df.hint("merge")


def _longest(vocabulary: DataFrame) -> int:
    return vocabulary.where("NOT fixed").agg(F.max(F.length("term"))).first()[0] or 0


def repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, sim, part): what each distinct token may stand for, all ways with their best similarity; part is 1 or 2 where the term is only the start or end of the token, else 0.

    vocabulary: (term, df, fixed), fixed for slots and symbols, which only match exactly. A token is near a term by edits only if it is at most two
    letters longer than the longest term, so no length of token is left out. Abbreviations of general terms, which `GENERAL` entries or more
    share, are usual; others count by the share of letters that they keep.
    """
    longest = _longest(vocabulary)
    exact = tokens.join(spread(vocabulary), F.col("token") == F.col("term")).select("token", "term", F.lit(1.0).alias("sim"))
    word = vocabulary.where("NOT fixed").select("term", "df")
    open_ = tokens.join(spread(vocabulary.where("NOT fixed").select(F.col("term").alias("token"))), "token", "left_anti").where(~is_slot(F.col("token")))
    # spread before the rows multiply, else they are few bytes and meet in one task
    open_ = checkpointed(open_.repartition(4 * partitions(tokens.sparkSession), "token"))
    n, m = F.length("token"), F.length("term")
    lists = word.where(m >= 4).select("term", F.explode(deletions(F.col("term"), _reach(F.col("term")) == 2)).alias("left"))
    near = (
        open_.where(n.between(4, longest + 2))
        .select("token", F.explode(deletions(F.col("token"), _reach(F.col("token")) == 2)).alias("left"))
        .join(spread(lists), "left")
        .select("token", "term")
        .withColumn("d", F.levenshtein("token", "term", 2))
        .withColumn("d", F.when((F.col("d") == 2) & (n == m) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("term", ""))), 1).otherwise(F.col("d")))  # two letters that changed places are one edit
        .where((F.col("d") >= 0) & (F.col("d") <= F.least(_reach(F.col("token")), _reach(F.col("term")))))
        .select("token", "term", (1 - F.col("d") / F.greatest(n, m)).alias("sim"))
    )
    # the first, second and last letter of an abbreviation stand in this order in the word, the first at its start
    letter = lambda t, i: F.substring(t, i, F.lit(1))
    places = F.sequence(F.lit(2), m)
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i, m), lambda j: F.concat(letter(F.col("term"), F.lit(1)), letter(F.col("term"), i), letter(F.col("term"), j)))))
    single = F.array(F.col("term"), F.regexp_replace(F.regexp_replace("term", "ies$", "y"), "(?<=[a-z]{3})s$", ""))  # an abbreviation may be of the singular
    general = word.where(m >= 4).select(F.col("term").alias("plural"), (F.col("df") >= GENERAL).alias("usual"), F.explode(F.array_distinct(single)).alias("term"))
    general = general.select("plural", "usual", "term", F.explode(F.array_distinct(runs)).alias("run"))
    short = open_.where(n.between(2, longest - 1)).select("token", F.concat(letter(F.col("token"), F.lit(1)), letter(F.col("token"), F.lit(2)), letter(F.col("token"), n)).alias("run"))
    cut = (
        short.join(spread(general), "run")
        .where((m > n) & (F.col("usual") | (n >= 4)) & (F.levenshtein("token", "term") == m - n))
        .select("token", F.col("plural").alias("term"), F.when(~F.col("usual"), n / m).when(n >= 3, 0.9).otherwise(0.6).alias("sim"))
    )
    starts = word.where(m >= 5).select("term", F.explode(F.transform(F.sequence(F.lit(4), m - 1), lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("token"))
    begun = open_.join(spread(starts), "token").select("token", "term", F.greatest(n / m, F.lit(0.6)).alias("sim"))
    long_ = word.where(m >= 5).select("term")
    end = lambda text, part: F.struct(text.alias("term"), F.lit(part).alias("part"))
    ends = F.concat(
        F.transform(F.sequence(F.lit(5), F.least(n - 3, F.lit(max(longest, 5)))), lambda i: end(F.substring(F.col("token"), F.lit(1), i), 1)),
        F.transform(F.sequence(F.greatest(n - max(longest, 5) + 1, F.lit(4)), n - 3), lambda i: end(F.substring(F.col("token"), i, n), 2)),
    )
    glued = open_.where(n >= 8).select("token", F.explode(ends).alias("e")).select("token", "e.*").join(spread(long_), "term").select("token", "term", F.lit(0.9).alias("sim"), "part")
    return exact.unionByName(near).unionByName(cut).unionByName(begun).withColumn("part", F.lit(0)).unionByName(glued).groupBy("token", "term").agg(F.max("sim").alias("sim"), F.min("part").alias("part"))


def read_values(values: DataFrame, reference: DataFrame, entry_id: str = "asset_id", name: str = "canonical_name", symbols: tuple[str, ...] = ("ticker", "former_ticker")) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(values, terms, built, entries): the values with their number v, the terms of the entries, what each value may stand for (a row per v), and the entries' weights.

    values: one column, value, of distinct texts that are not null.
    """
    terms = checkpointed(reference_terms(reference, entry_id, name, list(symbols)))
    vocabulary = terms.groupBy("term").agg(F.max("df").alias("df"), F.max(F.col("kind").isin("name", "legal")).alias("word"), F.max("weight").alias("weight"))
    vocabulary = checkpointed(vocabulary.select("term", "df", (~F.col("word")).alias("fixed"), "weight"))
    values = checkpointed(values.select("value", words(F.col("value")).alias("ts")).withColumn("v", F.monotonically_increasing_id()))  # written once, so ids stand
    t = lambda i: F.get("ts", i)
    unit = F.transform(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.array_compact(F.array(t(i), F.when((i > 0) & ~is_slot(t(i)), F.concat(t(i - 1), t(i))), F.when(~is_slot(t(i)), F.concat(t(i), t(i + 1))))).alias("forms"),
        ),
    )
    units = values.where(F.size("ts") > 0).select("v", F.explode(unit).alias("u")).select("v", "u.pos", F.posexplode("u.forms").alias("form", "token"))
    found = repairs(units.select("token").distinct(), vocabulary.drop("weight")).join(spread(vocabulary.select("term", "weight", F.col("df").alias("held"))), "term")
    of = lambda part: F.max(F.when((F.col("part") == part) & (F.col("sim") >= STRONG), F.col("weight")))
    found = found.groupBy("token").agg(F.greatest(of(0), F.when(of(1).isNotNull() | of(2).isNotNull(), F.coalesce(of(1), F.lit(0.0)) + F.coalesce(of(2), F.lit(0.0)))).alias("known"), F.collect_list(F.struct("term", "sim", "part", "held")).alias("cands"))
    # weight of a token: that of the best term it likely stands for, or else its own rarity among the values
    totals = values.agg(F.count(F.lit(1)).alias("n_values")).crossJoin(reference.agg(F.count(F.lit(1)).alias("n_entries")))
    own = values.select(F.explode(F.array_distinct("ts")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("among"))
    tokens = checkpointed(found.join(spread(own), "token", "full_outer").crossJoin(F.broadcast(totals)))  # one row
    free = F.least(F.log1p(F.col("n_values") / F.col("among")) * F.log1p("n_entries") / F.log1p("n_values"), F.lit(HEAVIEST))
    token = F.col("token")
    stated = F.when(token.isin(*LEGAL), F.least(free, F.lit(0.3))).when(is_slot(token) & ~token.rlike("[%:]"), F.least(free, F.lit(1.5))).otherwise(free)
    none = F.array().cast("array<struct<term:string,sim:double,part:int,held:bigint>>")
    tokens = tokens.select("token", F.coalesce("known", stated).alias("w"), F.coalesce("cands", none).alias("cands"))
    # all that each unit of each value may stand for, a row per value
    each = units.join(spread(tokens), "token").select("v", "form", "pos", F.when(F.col("form") == 0, token).alias("own"), F.when(F.col("form") == 0, F.col("w")).alias("w"),
                                            F.when(F.col("form") == 0, F.col("cands")).otherwise(F.filter("cands", lambda c: c["part"] == 0)).alias("cands"))  # an end of two joined tokens is one of them
    first = F.col("form") == 0
    kept = each.where(first | (F.size("cands") > 0)).groupBy("v").agg(
        F.sum("w").alias("whole"), F.collect_list(F.when(first, F.struct("pos", "w"))).alias("ws"), F.collect_list(F.when(F.size("cands") > 0, F.struct("pos", "cands"))).alias("cs"),
        *[F.collect_set(F.when(slot_kind(F.col("own")) == k, F.col("own"))).alias(k) for k in SLOTS], F.max(F.coalesce(is_slot(F.col("own")), F.lit(False))).alias("states"),
    )
    built = kept.withColumn("flat", F.flatten(F.transform("cs", lambda u: F.transform(u["cands"], lambda c: F.struct(u["pos"].alias("pos"), c["term"].alias("term"), c["sim"].alias("sim"), c["held"].alias("held"))))))
    built = checkpointed(built.withColumn("year", F.when(F.size("rate") > 0, F.col("year")).otherwise(F.array().cast("array<string>"))).drop("cs"))
    slots = [F.collect_set(F.when(slot_kind(F.col("term")) == k, F.col("term"))).alias(f"e_{k}") for k in SLOTS]
    counted = F.col("kind") != "symbol"
    entries = terms.groupBy("entry").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(" "), "term"), "weight"))).alias("of"), *slots,
        F.sum(F.when(counted & (F.col("kind") != "slot"), F.col("weight"))).alias("named"), F.coalesce(F.sum(F.when(F.col("kind") == "slot", F.col("weight"))), F.lit(0.0)).alias("slotted"),
    )
    return values, terms, built, entries


def score_pairs(pairs: DataFrame, built: DataFrame, entries: DataFrame) -> DataFrame:
    """(v, entry, score) for those of the pairs (v, entry, anchored: whether the value meets an anchor of the entry) that share a term."""
    x = pairs.join(spread(entries), "entry").join(spread(built), "v")
    # a rate, number or class that the value does not state at all is not held against it
    asked = F.coalesce("named", F.lit(0.0)) + F.when(F.col("states"), F.col("slotted")).otherwise(0.0)
    clash = F.lit(False)
    for k in SLOTS:
        clash = clash | ((F.size(F.array_except(k, f"e_{k}")) > 0) & (F.size(f"e_{k}") > 0))
    weight = lambda kind: lambda c: F.try_element_at(F.col("of"), F.concat(F.lit(f"{kind} "), c["term"]))
    hit = F.transform("flat", lambda c: F.struct(c["pos"].alias("pos"), c["term"].alias("term"), c["sim"].alias("sim"), F.coalesce(weight("name")(c), weight("legal")(c), weight("slot")(c)).alias("weight"), weight("symbol")(c).isNotNull().alias("symbol")))
    hit = F.filter(hit, lambda c: c["weight"].isNotNull() | c["symbol"])
    x = x.select("v", "entry", "anchored", "whole", "ws", asked.alias("asked"), clash.alias("clash"), F.explode(hit).alias("h")).select("v", "entry", "anchored", "whole", "ws", "asked", "clash", "h.*")
    # each term of the entry and each unit of the value counts once, by its best likeness
    of_term, of_unit = Window.partitionBy("v", "entry", "term").orderBy(F.desc("sim"), "pos"), Window.partitionBy("v", "entry", "pos").orderBy(F.desc("sim"), "term")
    x = x.withColumn("by_term", F.row_number().over(of_term) == 1).withColumn("by_unit", F.row_number().over(of_unit) == 1)
    w = F.element_at(F.transform(F.filter("ws", lambda u: u["pos"] == F.col("pos")), lambda u: u["w"]), 1)
    x = x.groupBy("v", "entry").agg(
        F.coalesce(F.sum(F.when(F.col("by_term"), F.col("weight") * F.col("sim"))), F.lit(0.0)).alias("covers"), F.sum(F.when(F.col("by_unit"), w * F.col("sim"))).alias("covered"),
        F.max(F.col("symbol") & (F.col("sim") >= 1)).alias("coded"), F.first("asked").alias("asked"), F.first("whole").alias("whole"), F.first("clash").alias("clash"), F.first("anchored").alias("anchored"),
    )
    covers = F.greatest(F.coalesce(F.try_divide("covers", "asked"), F.lit(0.0)), F.when(F.col("coded"), 0.95).otherwise(0.0))
    covered = F.coalesce(F.try_divide("covered", "whole"), F.lit(0.0))
    # an entry none of whose anchors is met is another one, unless the value says next to nothing beyond it
    score = F.sqrt(covers * covered) * F.when(F.col("clash") | (~F.col("anchored") & (covered < WHOLE)), OTHER).otherwise(1.0)
    return x.select("v", "entry", score.alias("score"))


def rank_values(values: DataFrame, reference: DataFrame, entry_id: str = "asset_id", name: str = "canonical_name", symbols: tuple[str, ...] = ("ticker", "former_ticker")) -> DataFrame:
    """(value, entry, score) for each distinct value and every entry that may be its best, the best of all entries and ties with it of smaller number always among them.

    values: one column, value, of distinct texts that are not null. The anchors of an entry are its first word and its symbols.
    """
    values, terms, built, entries = read_values(values, reference, entry_id, name, symbols)
    met = built.select("v", F.explode(F.array_distinct(F.transform("flat", lambda c: c["term"]))).alias("term"))
    anchored = checkpointed(met.join(spread(terms.where("anchor").select("term", "entry")), "term").select("v", "entry").distinct())
    units = checkpointed(_units(built))
    pairs = anchored.withColumn("anchored", F.lit(True)).unionByName(_covering(units, built, terms).join(spread(anchored), ["v", "entry"], "left_anti").withColumn("anchored", F.lit(False)))
    scored = checkpointed(score_pairs(pairs, built, entries))
    # what is left out scores at most OTHER times the root of what the value's terms cover of it
    best = scored.groupBy("v").agg(F.max("score").alias("best"))
    limit = F.lit(OTHER) * F.sqrt(F.col("reachable") / F.col("whole")) + SLACK
    open_ = units.select("v", "whole", "reachable").distinct().join(spread(best), "v", "left").where(F.coalesce("best", F.lit(0.0)) < limit)
    return scored.unionByName(_best_of_rest(open_.select("v"), units, built, terms, entries)).join(spread(values.select("v", "value")), "v").select("value", "entry", "score")


def _units(built: DataFrame) -> DataFrame:
    """(v, pos, w, whole, gain, reachable, before) for each unit of each value that may stand for a term: its weight, what an entry can cover of it, the sum of that over the value, and over its units that fewer entries hold."""
    flat = built.select("v", F.explode("flat").alias("c")).select("v", "c.*")
    top = flat.repartition("v").groupBy("v", "pos").agg(F.max("sim").alias("top"), F.sum("held").alias("held"))
    of = built.select("v", "whole", F.explode("ws").alias("u")).select("v", "whole", "u.*").repartition("v")
    u = top.join(spread(of), ["v", "pos"]).withColumn("gain", F.col("w") * F.col("top"))
    each = Window.partitionBy("v")
    sofar = each.orderBy("held", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return u.select("v", "pos", "w", "whole", "gain", F.sum("gain").over(each).alias("reachable"), F.coalesce(F.sum("gain").over(sofar), F.lit(0.0)).alias("before"))


def _covering(units: DataFrame, built: DataFrame, terms: DataFrame) -> DataFrame:
    """(v, entry) for all entries that may cover `WHOLE` of a value's weight.

    Such an entry meets at least one of any units that together weigh more than it may leave uncovered. Those that fewest entries hold are looked up.
    """
    spare = F.col("reachable") - (WHOLE - SLACK) * F.col("whole")
    asked = units.where((spare >= 0) & (F.col("before") <= spare)).select("v", "pos")
    flat = built.select("v", F.explode("flat").alias("c")).select("v", "c.pos", "c.term")
    return flat.join(spread(asked), ["v", "pos"]).select("v", "term").distinct().join(spread(terms.select("term", "entry")), "term").select("v", "entry").distinct()


def _best_of_rest(open_: DataFrame, units: DataFrame, built: DataFrame, terms: DataFrame, entries: DataFrame) -> DataFrame:
    """(v, entry, score) for each v of open_: the best of all entries, as scored where the value doesn't meet their anchors and they don't cover it whole.

    Entries that are alike but for their anchors are one class here, and so are values with the same known units: what a value's other words weigh
    doesn't change which entry is best.
    """
    flat = built.join(spread(open_), "v", "left_semi").select("v", "states", F.explode("flat").alias("c")).select("v", "states", "c.pos", "c.term", "c.sim")
    known = flat.join(spread(units.select("v", "pos", "w", "whole")), ["v", "pos"]).groupBy("v", "pos").agg(
        F.first("states").alias("states"), F.first("w").alias("w"), F.first("whole").alias("whole"), F.array_sort(F.collect_set(F.struct("term", "sim"))).alias("cands"))
    known = known.groupBy("v").agg(F.first("states").alias("states"), F.first("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("w", "cands"))).alias("units"))
    known = checkpointed(known.withColumn("key", F.sha2(F.to_json(F.struct("states", "units")), 256)))
    tails = terms.where("NOT anchor").groupBy("entry").agg(F.array_sort(F.collect_set(F.struct("term", "weight"))).alias("tail"))
    near = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 12).alias(c)
    classes = tails.join(spread(entries.select("entry", near("named"), near("slotted"))), "entry").groupBy("tail", "named", "slotted").agg(F.min("entry").alias("entry"))
    held = classes.select("entry", "named", "slotted", F.explode("tail").alias("t")).select("entry", "named", "slotted", "t.*")
    asked = known.groupBy("key").agg(F.first("states").alias("states"), F.first("units").alias("units")).select("key", "states", F.posexplode("units").alias("pos", "u"))
    asked = asked.select("key", "states", "pos", "u.w", F.explode("u.cands").alias("c")).select("key", "states", "pos", "w", "c.*")
    x = asked.join(spread(held), "term").repartition("key", "entry")
    of_term, of_unit = Window.partitionBy("key", "entry", "term").orderBy(F.desc("sim"), "pos"), Window.partitionBy("key", "entry", "pos").orderBy(F.desc("sim"), "term")
    x = x.withColumn("by_term", F.row_number().over(of_term) == 1).withColumn("by_unit", F.row_number().over(of_unit) == 1)
    x = x.groupBy("key", "entry").agg(
        F.sum(F.when(F.col("by_term"), F.col("weight") * F.col("sim"))).alias("covers"), F.sum(F.when(F.col("by_unit"), F.col("w") * F.col("sim"))).alias("covered"),
        F.first(F.col("named") + F.when(F.col("states"), F.col("slotted")).otherwise(0.0)).alias("asked"),
    )
    both = F.coalesce(F.try_divide("covers", "asked"), F.lit(0.0)) * F.col("covered")
    best = x.groupBy("key").agg(F.max(F.struct(F.round(both, 9).alias("near"), (-F.col("entry")).alias("back"), both.alias("both"))).alias("b"))
    return known.select("v", "whole", "key").join(spread(best), "key").select("v", (-F.col("b.back")).alias("entry"), (F.lit(OTHER) * F.sqrt(F.col("b.both") / F.col("whole"))).alias("score"))


def map_values(values: DataFrame, value_id: str, value: str, reference: DataFrame, threshold: float = 0.64, entry_id: str = "asset_id", name: str = "canonical_name",
               symbols: tuple[str, ...] = ("ticker", "former_ticker"), unmatched: int = 0) -> DataFrame:
    """(value_id, entry_id, score) for each row whose value is neither null nor only blanks.

    entry_id is `unmatched` where no entry reaches the threshold (score then is that of the best entry, or 0). Ties go to the smaller entry.
    Repeated values are ranked once and give a row for each of their rows; repeated reference entries compete like others. An empty
    reference leaves every value unmatched.
    """
    rows = values.select(F.col(value_id).cast("long").alias("row"), F.col(value).alias("value")).where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]"))
    ranked = rank_values(rows.select("value").distinct(), reference, entry_id, name, symbols)
    best = ranked.groupBy("value").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("entry")).alias("back"))).alias("b"))
    chosen = best.select(F.col("value").alias("v"), "b.score", F.when(F.col("b.score") >= threshold, -F.col("b.back")).alias("entry"))
    out = rows.join(spread(chosen), F.col("value") == F.col("v"), "left")
    return out.select(F.col("row").alias(value_id), F.coalesce("entry", F.lit(unmatched).cast("long")).alias(entry_id), F.coalesce("score", F.lit(0.0)).alias("score"))
