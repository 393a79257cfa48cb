"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Other candidates are credentials, phone numbers in national form, names,
addresses and numbers of persons and accounts; those that overlap a base span, or one of a kind with a more exact pattern, are dropped. All candidates, base ones too, get votes (1, -1, or 0 for none) of
regex, gazetteer and context labelers, which often disagree. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for a kind and how likely each pattern. A logistic span classifier is then trained on those probabilities from
features of the span and what surrounds it, with the labelers' cues among them, and adds the spans it finds likely: also spans on which no labeler voted.
Only counts of patterns reach the driver: votes (at most ``3 ** 5``) times the values of the features, for each kind.

A null text is empty. Rows that are equal in ``doc_id`` and text have equal results; every row is returned. Extra columns are ignored.
Without candidates nothing is added.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.rows import row_key
from codequarry.sources.scratch import stage

#: Kinds in the order of the digest, and their patterns. The groups repeat possessively, and matches may only begin
#: where a run begins or the last match ended; neither changes a match, and both keep the work linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other candidates.
MORE = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+",
    "national": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?:[\x20-]\p{Lu}\p{Ll}++){1,2}+(?![\p{L}\p{N}])",
    "address": r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}+\x20(?:\p{Lu}\p{Ll}++\x20){1,3}?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square)|\p{Lu}\p{Ll}*?(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}+)(?![\p{L}\p{N}])",
    "number": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])",
}
KINDS = [*BASE, *MORE]
#: Kinds whose patterns are so exact that looser candidates which overlap them are dropped.
EXACT = ["address", "number"]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteers: words before a span of a kind that speak for it, and words that speak against any.
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "write", "address"],
    "ip": ["ip", "host", "server", "from", "address", "login"],
    "card": ["card", "visa", "mastercard", "credit", "pay", "payment", "account"],
    "phone": ["phone", "tel", "call", "mobile", "cell", "fax", "contact", "text"],
    "secret": ["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "credential", "auth", "key"],
    "national": ["phone", "tel", "call", "mobile", "cell", "fax", "contact", "text"],
    "name": ["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "name", "named", "signed", "contact", "author", "patient", "attn", "dear", "sincerely"],
    "address": ["address", "live", "lives", "at", "street", "ship", "deliver", "home", "visit", "wohnt", "in"],
    "number": ["ssn", "social security", "iban", "account", "tax", "passport", "id"],
}
AGAINST = ["version", "page", "chapter", "isbn", "build", "commit", "sha", "hash", "model", "part", "sku", "serial", "order", "item", "ref", "figure", "section"]
FIRST_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen",
    "Anna", "Maria", "Peter", "Paul", "Hans", "Klaus", "Julia", "Laura", "Carlos", "Luis", "Ana", "Carmen", "Pierre", "Marie", "Jean", "Sophie", "Louis", "Emma", "Daniel", "Martin"]
NOT_NAMES = ["The", "This", "That", "New", "North", "South", "East", "West", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July",
    "August", "September", "October", "November", "December", "United", "University", "Open", "General", "Free", "License", "Privacy", "Terms", "Table",
    "Apache", "Public", "Creative", "Commons", "Software", "Foundation", "Licence", "Agreement", "Copyright", "Rights", "Reserved", "Corporation", "Company", "Institute", "Library", "Version"]
VOTES = ["shape", "gazetteer", "against", "context", "mixture"]
#: Features besides the votes, and how many values each has.
FEATURES = {"size": 6, "digits": 4, "variety": 3, "ahead": 3, "behind": 3}
LENGTHS = [14, 18, 22, 32, 48]


def _pieces(kind: str, pattern: str) -> Column:
    """Each match of the text with its number, the length of the gap before it, the gap's end and how the gap behind it begins."""
    need = {"email": "@", "phone": "+"}.get(kind)
    gaps = F.split("text", pattern, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("value"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["value"].alias("value"), F.lower(F.substring(x["gap"], -32, 32)).alias("before"), F.lower(F.left(x["next"], F.lit(8))).alias("after")))
    may = F.contains("text", F.lit(need)) if need else F.lit(True) if kind == "name" else F.col("text").rlike("[0-9]")
    return F.when(may, F.filter(rows, lambda x: x["value"].isNotNull()))


def _candidates(docs: DataFrame) -> DataFrame:
    """All matches with their places: running lengths of the gaps and matches before them. One pass over the texts, one shuffle of the matches."""
    rows = docs.select(row_key().alias("row_key"), F.monotonically_increasing_id().alias("copy"), "text")
    none = F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,value:string,before:string,after:string>>)")
    pieces = F.concat(*(F.coalesce(_pieces(k, p), none) for k, p in (BASE | MORE).items()))
    found = rows.select("row_key", "copy", F.inline(pieces)).repartition("row_key", "copy")
    order = Window.partitionBy("row_key", "copy", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = found.select("row_key", "copy", "kind", (end - F.length("value")).alias("start"), end.alias("end"), "value", "before", "after")
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _valid(kind)).otherwise(valid)
    good = placed.filter(valid)
    # A candidate that overlaps a base span is a part of it, or it of the candidate.
    by_place = Window.partitionBy("row_key", "copy").orderBy("start", "end")

    def overlaps(kinds: list[str]) -> Column:
        of = F.col("kind").isin(*kinds)
        reached = F.max(F.when(of, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
        nearest = F.min(F.when(of, F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce((reached > F.col("start")) | (nearest < F.col("end")), F.lit(False))

    marked = good.withColumns({"in_base": overlaps(list(BASE)), "in_exact": overlaps([*BASE, *EXACT])})
    kept = F.col("kind").isin(*BASE) | F.when(F.col("kind").isin(*EXACT), ~F.col("in_base")).otherwise(~F.col("in_exact"))
    return marked.filter(kept).drop("copy", "in_base", "in_exact")


def _valid(kind: str) -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    return {
        "ip": F.col("value").rlike(rf"^(?:{PART}\.){{3}}{PART}$"),
        "card": n.between(12, 19) & F.call_function("luhn_check", F.left(digits, F.lit(19))),
        "phone": n.between(9, 15),
        "secret": F.col("value").rlike("[A-Za-z]"),
        "name": F.size(F.array_distinct(F.split("value", "[ -]"))) == F.size(F.split("value", "[ -]")),
    }.get(kind, F.lit(True))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _words(names: list[str]) -> str:
    return "(?:" + "|".join(names) + ")"


def _by_kind(of: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for kind, value in of.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def _voted(candidates: DataFrame) -> DataFrame:
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    yes, no = F.lit(True), F.lit(False)
    digits = F.length(F.regexp_replace(value, "[^0-9]", "")) / F.length(value)
    variety = F.size(F.array_distinct(F.split(value, ""))) / F.length(value)
    runs = F.regexp_count(value, F.lit("[0-9]+"))
    shape = {
        "email": _vote(value.rlike(r"\.(?:com|org|net|edu|de|fr|es|uk|io)$"), value.rlike(r"\.[0-9]+$")),
        "ip": _vote(value.rlike(r"^[1-9][0-9]{1,2}\."), value.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
        "card": _vote(value.rlike("^(?:4|5[1-5]|3[47]|6011)"), value.rlike("^0")),
        "phone": _vote(value.rlike(r"^\+[1-9]"), value.rlike(r"^\+0")),
        "secret": _vote(value.rlike("^AKIA[0-9A-Z]{16}$|^[0-9a-f]{32,}$|^(?:sk|pk|ghp|xox[bp])[_-]"), value.rlike("^[A-Za-z]+[_-]?[0-9]{1,4}$|^[A-Za-z]+(?:-[A-Za-z]+)+-?[0-9]*$|^[0-9]{4}-[0-9]{2}-[0-9]{2}")),
        "national": _vote(value.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"), value.rlike("^0{3}|^[0-9]{3} ")),
        "name": _vote(F.split(value, "[ -]")[0].isin(*FIRST_NAMES), no),
        "address": _vote(value.rlike("^[1-9]|[1-9][0-9]?$"), value.rlike("^0")),
        "number": _vote(value.rlike("^[1-8][0-9]{2}-|^(?:DE|FR|ES|GB|IT|NL)[0-9]"), value.rlike("^000|^9|-00-")),
    }
    first = F.split(value, "[ -]")[0]
    cue = {kind: before.rlike(r"(?:^|[^\p{L}])" + _words(words) + r"[^\p{L}\p{N}]{1,6}(?:(?:is|no|number|at|of|me|us|to|s)[^\p{L}\p{N}]{1,4})?$") for kind, words in CUES.items()}
    gazetteer = {kind: _vote(said, no) for kind, said in cue.items()} | {"name": _vote(cue["name"], F.exists(F.split(value, "[ -]"), lambda w: w.isin(*NOT_NAMES)))}
    context = {
        "name": _vote(after.rlike(r"^(?:,| said| wrote|'s| \()"), before.rlike(r"(?:^|[.!?:\n]\s*)$") & ~first.isin(*FIRST_NAMES)),
        "address": _vote(after.rlike("^(?:,|\\.|\n|$)"), no),
    }
    mixture = {
        "secret": _vote((F.length(value) >= 20) & (runs >= 3), runs <= 1),
        "name": _vote(no, F.length(value) > 36),
    }
    votes = {
        "shape": _by_kind(shape, F.lit(0)),
        "gazetteer": _by_kind(gazetteer, F.lit(0)),
        "against": _vote(no, before.rlike(r"(?:^|[^\p{L}])" + _words(AGAINST) + r"[^\p{L}\p{N}]{1,4}(?:(?:no|number|id)[^\p{L}\p{N}]{1,4})?$")),
        "context": _by_kind(context, _vote(before.rlike("[=:]\\s*[\"'`]?$"), before.rlike("[$€£#/\\\\]$") | after.rlike("^(?:%|px|kg|\\.[a-z])"))),
        "mixture": _by_kind(mixture, _vote(variety.between(0.3, 0.8), variety < 0.2)),
    }
    size = F.lit(0)
    for k, n in enumerate(LENGTHS):
        size = F.when(F.length(value) >= n, k + 1).otherwise(size)
    features = {
        "size": size,
        "digits": F.when(digits == 0, 0).when(digits < 0.3, 1).when(digits < 0.8, 2).otherwise(3),
        "variety": F.when(variety < 0.3, 0).when(variety < 0.6, 1).otherwise(2),
        "ahead": F.when(before.rlike("[\"'`(=:]\\s?$"), 0).when(before.rlike(r"[\p{L}\p{N},]\s$"), 1).otherwise(2),
        "behind": F.when(after.rlike("^[\"'`)]"), 0).when(after.rlike(r"^[\s,.;!?]|^$"), 1).otherwise(2),
    }
    return candidates.withColumns(votes | features)


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation: for each labeler the chance of each vote on false and true spans, and each pattern's probability of being true.

    What a vote stands for is fixed, and only its weight is learned: where the counts would make a vote for a kind less likely on true spans than on false ones, or a
    vote against one more likely, it has no weight. Without any vote for it no pattern of a kind is true.
    """
    if not any(1 in p for p in counts):
        return [], dict.fromkeys(counts, 0.0)
    belief = {p: 1 / (1 + math.exp(-1.5 * (sum(p) - 0.5))) for p in counts}
    tables: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        true = sum(counts[p] * belief[p] for p in counts) + 1
        false = sum(counts[p] * (1 - belief[p]) for p in counts) + 1
        tables = []
        for j in range(len(next(iter(counts)))):
            seen = {v: [1 + v * -0.5, 1 + v * 0.5] for v in (-1, 0, 1)}  # labelers are taken to be better than chance at first
            for p, n in counts.items():
                seen[p[j]][0] += n * (1 - belief[p])
                seen[p[j]][1] += n * belief[p]
            chance = {v: (a / (false + 2), b / (true + 2)) for v, (a, b) in seen.items()}
            for v in (-1, 1):
                if v * (chance[v][1] - chance[v][0]) < 0:
                    chance[v] = (sum(seen[v]) / (false + true + 4),) * 2
            tables.append(chance)
        for p in counts:
            odds = math.log(true / false) + sum(math.log(tables[j][v][1] / tables[j][v][0]) for j, v in enumerate(p))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return tables, belief


def _features(votes: tuple[int, ...], values: tuple[int, ...]) -> list[int]:
    return [1, *(int(v == 1) for v in votes), *(int(v == -1) for v in votes), *(int(x == k) for x, n in zip(values, FEATURES.values(), strict=True) for k in range(n))]


def classifier(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int], rounds: int = 300) -> list[float]:
    """Weights of the logistic span classifier, by gradient steps on the beliefs that the labelers' reliabilities give."""
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for (votes, _), n in counts.items():
        patterns[votes] += n
    belief = reliabilities(patterns)[1]
    cases = np.array([_features(votes, values) for votes, values in counts], np.float64)
    target, share = np.array([belief[votes] for votes, _ in counts]), np.array(list(counts.values()), np.float64)
    share /= share.sum()
    weights = np.zeros(cases.shape[1])
    for _ in range(rounds):
        error = target - 1 / (1 + np.exp(-(cases @ weights)))
        weights += 2.0 * (cases.T @ (share * error) - 1e-3 * weights)
    return weights.tolist()


def _likelihood(weights: list[float]) -> Column:
    terms = [F.lit(1), *((F.col(v) == 1).cast("int") for v in VOTES), *((F.col(v) == -1).cast("int") for v in VOTES), *((F.col(f) == k).cast("int") for f, n in FEATURES.items() for k in range(n))]
    total = sum((F.lit(w) * t for w, t in zip(weights, terms, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def find_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``row_key`` and span (``kind``, ``start``, ``end`` in code points, end exclusive, ``probability``) of all personal data; base spans whatever their probability."""
    voted = stage(_voted(_candidates(docs)).drop("value", "before", "after"), "span-votes")
    counted: dict[str, dict] = defaultdict(dict)
    for r in voted.groupBy("kind", *VOTES, *FEATURES).count().collect():
        counted[r.kind][tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES)] = r["count"]
    probability = _by_kind({kind: _likelihood(classifier(counts)) for kind, counts in counted.items()}, F.lit(1.0))
    judged = voted.withColumn("probability", probability)
    return judged.filter(F.col("kind").isin(*BASE) | (F.col("probability") >= least)).select("row_key", "kind", "start", "end", "probability")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the count of each base kind, ``base_sha256``, ``spans`` for every row."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = find_spans(docs).select("row_key", F.struct("start", rank.alias("rank"), "end", "kind").alias("span"))
    # One set of spans per document; rows that are copies of each other in id and text give the same set.
    listed = spans.groupBy("row_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    rows = docs.select("doc_id", row_key().alias("row_key"))
    found = rows.join(listed, "row_key", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")))

    def text(only_base: bool) -> Column:
        some = F.filter("spans", lambda s: s["rank"] <= len(BASE)) if only_base else F.col("spans")
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(text(True), 256).alias("base_sha256"), text(False).alias("spans"))
