"""Secret scans over a trigram inverted index, with DataFrame and SQL functions only.

Each rule's regular expression is turned into a Boolean query over trigrams: every match must contain one of a
finite set of strings at each literal stretch of the expression, hence all trigrams of that string. The index holds,
for every block of document ids and every trigram that some rule asks for, the list of documents that contain it. The
queries intersect and unite these postings; only the candidates are verified with the expression itself. A rule whose
expression has no mandatory trigram scans every text.

Defined results: null text is empty text; a row with a null id is verified with every rule; rows that share an id are
candidates together and are reported each; an empty table gives an empty result; very long texts are scanned whole, in
one row; other columns of the input, whatever their names, pass through redact() and are not read by digest().
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import stored, texts

#: Documents of a block of the index; bounds every posting list.
BLOCK_IDS = 256
#: Candidates that are broadcast at most, some 100 bytes each; more of them meet their rows by a shuffle.
BROADCAST_ROWS = 500_000
#: Strings that one literal stretch may stand for before it is cut.
MAX_STRINGS = 64
#: Trigrams that a string keeps in its query: the rarest ones; any subset of the mandatory trigrams is sound.
KEPT_GRAMS = 2
# Fixed value: the letters of running text from the most to the least frequent, after the space.
BY_FREQUENCY = " etaoinshrdlcumwfgypbvkjxqz"


@dataclass(frozen=True)
class Rule:
    """kind; the expression, read alike by Java, RE2 and Python; the group that holds the secret; its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds of secret and their expressions, base kinds first, in the order in which spans of one start sort.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("urlauth", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@"),
)
RULES = BASE_RULES + ADDED_RULES

#: A query: every clause must hold; a clause holds if all trigrams of one of its sets occur.
Query = tuple[frozenset[frozenset[str]], ...]


def _rarity(gram: str) -> tuple[int, str]:
    return -sum(BY_FREQUENCY.find(c) % (len(BY_FREQUENCY) + 1) for c in gram), gram


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, on lower-cased text; empty if nothing is mandatory."""
    clauses: list[frozenset[frozenset[str]]] = []
    run: set[str] = {""}

    def cut() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            # A string that contains another adds nothing to the alternatives.
            least = [s for s in run if not any(x != s and x in s for x in run)]
            clauses.append(frozenset(frozenset(sorted({s[i : i + 3] for i in range(len(s) - 2)}, key=_rarity)[:KEPT_GRAMS]) for s in least))
        run = {""}

    def finite(op, arg) -> set[str] | None:
        """All strings that a node matches, lower-cased, or None if they are too many."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return every(arg[-1])
        if op is sre.BRANCH:
            parts = [every(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 3:
            one = every(arg[2])
            return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        return None

    def every(seq) -> set[str] | None:
        out = {""}
        for op, arg in seq:
            part = finite(op, arg)
            if part is None or len(out) * len(part) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def walk(seq) -> None:
        nonlocal run
        for op, arg in seq:
            part = finite(op, arg)
            if part is not None and len(run) * len(part) <= MAX_STRINGS:
                run = {a + b for a in run for b in part}
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            else:
                cut()
                if part is not None:
                    run = set(part)
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1 and (once := every(arg[2])) is not None:
                    run = once
                    cut()

    walk(sre_parser.parse(pattern))
    cut()
    return tuple(clauses)


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(block, gram, postings): for each block of ids, the sorted ids of documents that contain the trigram."""
    asked = F.array(*map(F.lit, grams))
    # The lambda over an array of one keeps the lower-cased text from being made anew for every trigram.
    present = F.transform(F.array(F.lower("text")), lambda low: F.filter(asked, lambda g: F.contains(low, g)))[0]
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(present).alias("gram"))
        .groupBy(F.floor(F.col("doc_id") / BLOCK_IDS).alias("block"), "gram")
        .agg(F.array_sort(F.collect_set("doc_id")).alias("postings"))
    )


def _tagged(number: int):
    return lambda d: F.struct(d.alias("doc_id"), F.lit(number).alias("rule"))


def _is(number: int):
    return lambda x: x["kind"] == number


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the documents whose postings satisfy a rule's query, with those rules' numbers."""
    none = F.array().cast("array<bigint>")
    by_gram = F.map_from_entries(F.collect_list(F.struct("gram", "postings")))

    def postings(gram: str) -> Column:
        return F.coalesce(F.element_at("grams", F.lit(gram)), none)

    found = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if not query:
            continue
        every = None
        for clause in query:
            some = None
            for grams in sorted(clause, key=sorted):
                both = None
                for g in sorted(grams):
                    both = postings(g) if both is None else F.array_intersect(both, postings(g))
                some = both if some is None else F.array_union(some, both)
            every = some if every is None else F.array_intersect(every, some)
        found.append(F.transform(every, _tagged(i)))
    return (
        index.groupBy("block")
        .agg(by_gram.alias("grams"))
        .select(F.explode(F.concat(*found)).alias("x"))
        .groupBy("x.doc_id")
        .agg(F.collect_set("x.rule").alias("rules"))
    )


def _spans(rule: Rule, number: int) -> Column:
    """Structs (start, kind number, end) of a rule's matches in `text` whose secret is long enough."""
    rx = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all("text", rx, F.lit(0)), lambda x: F.length(x)).alias("long"),
        F.transform(F.regexp_extract_all("text", rx, F.lit(rule.group)), lambda x: F.length(x)).alias("secret"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["long"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["secret"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row, found): per row, the row itself and the spans of all rules as sorted structs (start, kind number, end)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for some in clause for g in some})
    if grams:
        asked_of = stored(candidates(trigram_index(texts(docs, id_col, text_col), grams), rules), "candidates")
        # Few candidates go to the texts, so no text is shuffled.
        few = asked_of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(asked_of) if few else asked_of, "doc_id", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        asked = F.coalesce(F.col("doc_id").isNull() | F.array_contains("rules", i), F.lit(False)) if queries[i] else F.lit(True)
        if rule.pattern.startswith("[") and rule.pattern.endswith("]+"):
            # Runs of one class are maximal, so the least length may move into the expression.
            rule = Rule(rule.kind, rule.pattern[:-1] + f"{{{rule.least},}}")
        found.append(F.when(asked & F.col("text").rlike(rule.pattern), _spans(rule, i)).otherwise(none))
    return rows.select("doc_id", "text", "row", F.array_sort(F.concat(*found)).alias("found"))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, per row of scan()."""
    base = len(BASE_RULES)
    names = F.array(*[F.lit(r.kind) for r in rules])

    def text(x: Column) -> Column:
        return F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))

    counts = [F.size(F.filter("found", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(F.concat_ws(",", F.transform(F.filter("found", lambda x: x["kind"] < base), text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", text)).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a mask in place of every span of text_col; overlapping and touching spans share one mask; null stays null."""

    def step(acc: Column, x: Column) -> Column:
        joins = (x["start"] <= acc["at"]) & (acc["at"] > 0)
        gap = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(joins, acc["out"]).otherwise(gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    original = F.col("row").getField(text_col)
    text = F.when(original.isNull() | (F.size("found") == 0), original).otherwise(clean)
    return scan(docs, rules, id_col, text_col).select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
