"""Personal data by weak supervision.

Candidates are what the base patterns match, pass or fail, and looser patterns of further kinds. Seven labelers vote on
each candidate, for, against or not at all: checks of its form, gazetteers (country codes, issuers, domains, given
names), words around it and its neighbouring characters. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without labels; the posterior of each candidate then trains the final span
classifier, a log-linear model over the candidate's form and surroundings. Base matches that pass their checks are always
reported; of the further kinds, those that pass theirs and that the classifier takes for personal data.

Vote patterns are few, however many the candidates: every pass over the data is one aggregation that merges inside the
map tasks, and only model parameters reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import let, text_or_empty
from tablescope.sources.shared import cut_lineage

BASE_KINDS = ("email", "ip", "card", "phone")
WEAK_KINDS = ("mail", "tel", "ssn", "iban", "name")
KINDS = BASE_KINDS + WEAK_KINDS
ROUNDS = 12

#: Each finds the leftmost non-overlapping matches of its kind. Possessive repeats change no match, as nothing that
#: follows could take what they hold; the starts keep a search from beginning again inside a run that has failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "tel": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-]?[0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}

# Gazetteers and context words (fixed values).
DOMAINS = "com org net edu gov io de fr es it uk eu info biz us ca au ch at nl be pl se no dk fi pt ie jp cn in br mx".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358 359 380 420 421 852 886 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
GIVEN_NAMES = "Anna Maria Peter Paul John Mary James Robert Michael David Thomas Sarah Laura Julia Hans Klaus Sophie Marie Pierre Jean Carlos Jose Juan Ana Luis Emma Lena Lukas Max Nina Olivia Daniel Eva Jan Tom".split()
CONTEXT = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "mail": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|login|from|server",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"call|phone|tel|fax|mobile|cell|contact|ruf",
    "tel": r"call|phone|tel|fax|mobile|cell|contact|ruf",
    "ssn": r"ssn|social|security",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "name": r"name|dear|signed|from|contact",
}
AGAINST = r"version|isbn|issn|order|ref\b|item|page|figure|table|section|http|sha|md5|uuid|serial|token|secret|key"
LABELERS = ("form", "gazetteer", "context", "against", "alone", "grouped", "varied")
FEATURES = ("kind", "length", "digits", "before", "after", "votes")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(code: Column) -> Column:
    """Whether an account number's check digits are right; letters count from 10 on."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a)
        .when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return value == 1


def _passes(kind: str, s: Column) -> Column:
    """The check of a kind's form; for base kinds the one the base rule asks for."""
    if kind == "ip":
        return s.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return let(_digits(s), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return _mod97(s)
    if kind == "tel":
        return F.length(_digits(s)).between(9, 12)
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """``array<struct<kind,start,end,base,form,piece>>`` of the matches of a kind.

    The pieces between the matches and the matches themselves make up the text, so their lengths give the offsets.
    """
    pattern = PATTERNS[kind]

    def placed(matches: Column) -> Column:
        def offsets(between: Column) -> Column:
            empty = F.array().cast("array<struct<start:bigint,end:bigint,piece:string>>")
            start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

            def step(state: Column, x: Column) -> Column:
                begin = state["at"] + F.length(x["gap"])
                end = begin + F.length(x["piece"])
                span = F.struct(begin.alias("start"), end.alias("end"), x["piece"].alias("piece"))
                return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

            pairs = F.zip_with(
                F.slice(between, 1, F.size(matches)), matches, lambda g, p: F.struct(g.alias("gap"), p.alias("piece"))
            )
            return F.aggregate(pairs, start, step, lambda s: s["out"])

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), offsets)).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint,piece:string>>")
        )

    spans = F.transform(
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed),
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _passes(kind, s["piece"]).alias("form"),
            s["piece"].alias("piece"),
        ),
    )
    if kind == "card":  # short runs of digits are neither cards nor worth a vote
        spans = F.filter(spans, lambda s: s["form"] | (F.length(_digits(s["piece"])) >= 9))
    return spans


def _vote(positive: Column | None, negative: Column | None = None) -> Column:
    vote = F.when(negative, -1).otherwise(0) if negative is not None else F.lit(0)
    return F.when(positive, 1).otherwise(vote) if positive is not None else vote


def _by_kind(kind: Column, values: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _gazetteer(kind: Column, piece: Column) -> Column:
    domain = F.lower(F.element_at(F.split(piece, r"[^A-Za-z0-9-]+"), -1)).isin(DOMAINS)
    code = piece.rlike(r"^\+(?:" + "|".join(COUNTRY_CODES) + ")")
    issuer = piece.rlike(ISSUERS)
    reserved = piece.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.")
    country = F.substring(piece, 1, 2).isin(IBAN_COUNTRIES)
    given = F.exists(F.split(piece, r"[\x20.]+"), lambda w: w.isin(GIVEN_NAMES))
    return _by_kind(
        kind,
        {
            "email": _vote(domain),
            "mail": _vote(domain),
            "phone": _vote(code, ~code),
            "card": _vote(issuer, ~issuer),
            "ip": _vote(None, reserved),
            "iban": _vote(country, ~country),
            "name": _vote(given, ~given),
        },
        F.lit(0),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, found``: per row the candidates with place, whether they are base matches, votes and features."""
    t = F.col("t")
    rows = docs.select("doc_id", text_or_empty(text).alias("t"))
    base = F.concat(*(_found(k, t) for k in BASE_KINDS))
    weak = F.concat(*(_found(k, t) for k in WEAK_KINDS))

    def apart(both: Column) -> Column:
        """Of the further kinds, those that touch no valid base match, and of numbers those that are part of no code."""

        def touches(w: Column, other: Column) -> Column:
            return (other["start"] < w["end"]) & (w["start"] < other["end"])

        return F.concat(
            both["base"],
            F.filter(
                both["weak"],
                lambda w: ~F.exists(both["base"], lambda b: b["form"] & touches(w, b))
                & ~((w["kind"] == "tel") & F.exists(both["weak"], lambda o: o["kind"].isin("ssn", "iban") & touches(w, o))),
            ),
        )

    def voted(s: Column) -> Column:
        kind, piece = s["kind"], s["piece"]
        left = F.lower(t.substr(F.greatest(s["start"] - 31, F.lit(1)).cast("int"), F.least(s["start"], F.lit(32)).cast("int")))
        before = t.substr(s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0))
        after = t.substr((s["end"] + 1).cast("int"), F.lit(1))
        glued = before.rlike(r"[\p{L}0-9_]") | after.rlike(r"[\p{L}0-9_]")
        near = _by_kind(kind, {k: left.rlike(p) for k, p in CONTEXT.items()}, F.lit(False))
        grouped = piece.rlike(r"[0-9][\x20.()-]+[0-9]")
        digits = _digits(piece)
        votes = [
            F.when(kind == "name", 0).otherwise(_vote(s["form"], ~s["form"])),
            _gazetteer(kind, piece),
            _vote(near),
            _vote(None, left.rlike(AGAINST)),
            _vote(None, glued),
            _vote(grouped & ~kind.isin("ip")),
            _vote(None, digits.rlike(r"^([0-9])\1{5,}$|^0?123456")),
        ]

        def sort_of(c: Column) -> Column:
            return F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}_]"), "letter").when(
                c.rlike("[0-9]"), "digit"
            ).otherwise("mark")

        features = [
            kind,
            F.least(F.length(piece) / 4, F.lit(10)).cast("int").cast("string"),
            F.least(F.length(digits) / 3, F.lit(7)).cast("int").cast("string"),
            sort_of(before),
            sort_of(after),
            F.concat_ws(",", *(v.cast("string") for v in votes[:4])),
        ]
        return F.struct(
            kind.alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (s["form"] & kind.isin(*BASE_KINDS)).alias("base"),
            F.array(*(v.cast("int") for v in votes)).alias("votes"),
            F.array(*features).alias("features"),
        )

    both = let(F.struct(base.alias("base"), weak.alias("weak")), apart)
    return rows.select("doc_id", F.transform(both, voted).alias("found"))


def _log_odds(votes: Column, prior: float, odds: list[dict[int, float]]) -> Column:
    total = F.lit(prior)
    for j, table in enumerate(odds):
        vote = votes[j]
        total = total + F.when(vote > 0, table[1]).when(vote < 0, table[-1]).otherwise(table[0])
    return total


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of the prior and of each labeler's votes, by expectation-maximisation.

    ``patterns`` has ``votes, times``, a row per pattern of votes. Each round is one aggregation to a single row: the
    sums of the posteriors, in all and by labeler and vote. Votes start out as weak evidence for what they say, which
    also stays in force as a few pseudo-counts.
    """
    start = {1: math.log(4.0), 0: 0.0, -1: -math.log(4.0)}
    prior, odds = 0.0, [dict(start) for _ in LABELERS]
    pseudo = {1: (4.0, 1.0), 0: (5.0, 5.0), -1: (1.0, 4.0)}
    for _ in range(rounds):
        posterior = 1 / (1 + F.exp(-_log_odds(F.col("votes"), prior, odds)))
        rows = patterns.select("votes", "times", posterior.alias("p"))
        sums = [F.sum(F.col("times") * F.col("p")), F.sum("times")]
        for j in range(len(LABELERS)):
            for vote in (1, 0, -1):
                hit = F.when(F.col("votes")[j] == vote, F.col("times")).otherwise(0)
                sums += [F.sum(hit * F.col("p")), F.sum(hit)]
        got = [float(v or 0.0) for v in rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        yes, no = got[0] + 1.0, got[1] - got[0] + 1.0
        prior = math.log(yes / no)
        for j in range(len(LABELERS)):
            for i, vote in enumerate((1, 0, -1)):
                hit_yes, hit = got[2 + 6 * j + 2 * i], got[3 + 6 * j + 2 * i]
                a, b = pseudo[vote]
                odds[j][vote] = math.log((hit_yes + a) / (yes + 10.0)) - math.log((hit - hit_yes + b) / (no + 10.0))
    return prior, odds


def classifier(found: DataFrame, prior: float, odds: list[dict[int, float]]) -> tuple[float, dict[str, float]]:
    """Constant and weight of each feature's values, from the posteriors of all candidates.

    ``found`` has ``features, votes, times``. Features have a fixed number of values, so one small table reaches the driver.
    """
    posterior = 1 / (1 + F.exp(-_log_odds(F.col("votes"), prior, odds)))
    rows = found.select("times", posterior.alias("p"), F.posexplode("features").alias("place", "value"))
    table = rows.groupBy("place", "value").agg(
        F.sum(F.col("times") * F.col("p")).alias("yes"), F.sum(F.col("times") * (1 - F.col("p"))).alias("no")
    )
    got = table.collect()
    yes = sum(r["yes"] for r in got if r["place"] == 0) + 1.0
    no = sum(r["no"] for r in got if r["place"] == 0) + 1.0
    weights = {
        f"{r['place']}={r['value']}": math.log((r["yes"] + 0.5) / yes) - math.log((r["no"] + 0.5) / no) for r in got
    }
    return math.log(yes / no), weights


def personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, spans``: personal data of every whole text as ``array<struct<kind,start,end>>``, in order of start and kind.

    Offsets count code points, the end is exclusive. Null and empty texts have no spans. Equal rows give equal rows; other
    columns are not read; an empty table gives an empty result. Further kinds touch no valid base match.
    """
    table = cut_lineage(candidates(docs, text), "pii-candidates")
    each = table.select(F.explode("found").alias("c"))
    groups = cut_lineage(
        each.groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).agg(F.count("*").alias("times")),
        "pii-groups",
    )
    patterns = groups.groupBy("votes").agg(F.sum("times").alias("times"))
    prior, odds = reliabilities(cut_lineage(patterns, "pii-patterns"), rounds)
    constant, weights = classifier(groups, prior, odds)
    if weights:
        known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    else:
        known = F.create_map().cast("map<string,double>")

    def sure(c: Column) -> Column:
        parts = [
            F.coalesce(F.element_at(F.col("known"), F.concat(F.lit(f"{i}="), c["features"][i])), F.lit(0.0))
            for i in range(len(FEATURES))
        ]
        return reduce(lambda a, b: a + b, parts, F.lit(constant)) > 0

    # a further kind that fails its own check has a vote against it and is not reported whatever the others say
    reported = F.filter("found", lambda c: c["base"] | (c["kind"].isin(*WEAK_KINDS) & (c["votes"][0] >= 0) & sure(c)))
    order = {k: i for i, k in enumerate(KINDS)}
    ranked = F.sort_array(
        F.transform(
            reported,
            lambda c: F.struct(
                c["start"].alias("start"),
                _by_kind(c["kind"], {k: F.lit(i) for k, i in order.items()}, F.lit(len(order))).alias("rank"),
                c["end"].alias("end"),
                c["kind"].alias("kind"),
            ),
        )
    )
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return table.withColumn("known", known).select("doc_id", spans.alias("spans"))
