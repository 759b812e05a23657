"""Personal data by weak supervision, in SQL functions only.

Candidates are all spans that the kinds' patterns match, sound or not, and spans of wider
shapes (written-out addresses, numbers run together, other groupings) in the text outside
the sound ones. Four labelers vote for or against each or abstain: the kind's exact rule,
a gazetteer, words of the context, the characters at both edges. Their votes are counted
by pattern over the whole corpus; expectation-maximisation on these counts (at most 3^4
per kind) estimates how reliable each labeler is for each class, and its posteriors are
the soft labels of a logistic span classifier over votes and shapes, fitted on counts by
feature value. Sound spans of the base patterns always stay; the classifier adds wider
ones that also pass the kind's exact check.

Every text is cut at its matches; the lengths of the parts give the positions. All of it
happens in the document's own row: no text is shuffled, one small table is aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.session import written

KINDS = ("email", "ip", "card", "phone")

# Fixed by the contract, in forms that read every character at most a few times: a match
# starts where a run starts or the last match ended, and runs are not given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text holds that can match at all; most texts hold none of it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
AT, DOT = r"(?:at|AT|At|arroba|@)", r"(?:dot|DOT|Dot|punto|punkt|point|\.)"
# Wider shapes; each is tried in this order where the ones before do not match.
WIDE = {
    "marked address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20?{OPEN}\x20?{AT}\x20?{CLOSE}\x20?"
    rf"[A-Za-z0-9-]++(?:\x20?{OPEN}\x20?{DOT}\x20?{CLOSE}\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "spoken address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20(?:at|AT|arroba)\x20[A-Za-z0-9-]++"
    r"(?:\x20(?:dot|DOT|punto|punkt|point)\x20[A-Za-z0-9-]++)++",
    "long ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "marked ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])",
    "phone with plus": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "grouped number": r"(?<![0-9.-])[0-9]{4}([\x20.])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.-])",
    "number": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
}
SHAPE_KIND = {
    "marked address": "email", "spoken address": "email", "long ip": "ip", "marked ip": "ip",
    "phone with plus": "phone", "phone": "phone", "grouped number": "card", "number": "card",
}
WIDE_PATTERN = "|".join(WIDE.values())
WIDE_NEEDS = rf"[0-9]{{4}}|:[0-9A-Fa-f]{{1,4}}:|[\[(]\.[\])]|(?i:{OPEN}\x20?{AT}\x20?{CLOSE}|\x20(?:dot|punto|punkt|point)\x20)"

# Gazetteers. Common top-level domains, endings of file names, first digits
# of card issuers, dial codes.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|eu|de|fr|es|it|nl|be|at|ch|uk|ie|pt|pl|se|no|dk|fi|us|ca|mx|br|ar|au|nz|jp|cn|in|ru|za"
FILES = "png|jpg|jpeg|gif|svg|webp|css|js|json|html|xml|txt|pdf|zip|py|java"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|6(?:011|22|4[4-9]|5)|35|50|5[6-9]|6[3-9])"
DIAL_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1238]|35[0-9]|37[0-9]|38[0-9]|42[01]|85[2356]|88[06]|96[0-8]|97[1-7])"
AREA_CODES = r"^\(?[2-9][0-9]{2}\)?[\x20.-]\x20?[2-9][0-9]{2}"
HOSTS = r"^(?:[1-9][0-9]{0,2}[.\[(]|[23][0-9A-Fa-f]{3}:|f[cd][0-9A-Fa-f]{2}:|fe80:)"
NO_HOST = r"^(?:0|127|255)\.|\.(?:0|255)$"
# Words of the context, in the languages of the corpus.
CUES = {
    "email": r"mail|courriel|correo|contact|schreib|écri|escrib|write to|reach",
    "ip": r"\bip\b|host|server|serveur|servidor|address|adresse|dirección|client",
    "card": r"card|carte|karte|tarjeta|visa|mastercard|amex|credit|kredit|crédit|pan\b|payment",
    "phone": r"phone|tel|fon\b|call|mobile|móvil|handy|fax|sms|whatsapp|appel|ruf|llam|número",
}
ANTI_CUES = r"(?:version|ver\.?|\bv|isbn|issn|order|invoice|serial|sku|page|§|section|build|release|commit|hash|doi|\bid|\bno\.?|#)[\s:=.#\"'-]*$"
NEAR = 40

VOTES = ("rule", "gazetteer", "context", "edges")
FEATURES = (*VOTES, "shape", "size")
# Spans are added from this probability on.
ADDED_FROM = 0.8
EM_ROUNDS = 40
# How a labeler that does not abstain is believed to vote, (against, for), by class; weighs
# this share of the counts.
BELIEF = {0: (0.7, 0.3), 1: (0.15, 0.85)}
BELIEF_SHARE = 0.02
RIDGE = 1e-5
MASK = "\x01"
BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each of its entries, by blocks: its cost stays near linear."""

    def sums(x: Column) -> Column:
        grown = F.aggregate(
            x, F.array(F.lit(0)), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v))
        )
        return F.slice(grown, F.lit(2), F.size(x))

    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(BLOCK))
    inner = F.transform(starts, lambda at: sums(F.slice(numbers, at, F.lit(BLOCK))))
    totals = sums(F.transform(inner, lambda x: F.element_at(x, -1)))
    shifted = F.zip_with(inner, F.concat(F.array(F.lit(0)), totals), lambda x, before: F.transform(x, lambda v: v + before))
    # the running totals have one entry more than there are blocks; its block is null
    whole = F.flatten(F.filter(shifted, lambda x: x.isNotNull()))
    return F.when(F.size(numbers) > 0, whole).otherwise(F.array().cast("array<int>"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Luhn's sum of a string of digits."""
    back = F.reverse(number)

    def digit(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + digit(i))
    return F.length(number).between(13, 19) & (total % 10 == 0)


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    chosen = F.lit(None)
    for name in KINDS:
        chosen = F.when(kind == name, of[name]).otherwise(chosen)
    return chosen


def sound(kind: str, match: Column) -> Column:
    """The exact check of a match of the kind's base pattern."""
    return {
        "email": F.lit(True),
        "ip": match.rlike(OCTETS),
        "card": F.when(F.length(digits(match)).between(13, 19), passes_luhn(digits(match))).otherwise(False),
        "phone": F.length(digits(match)).between(9, 15),
    }[kind]


def _sound_wide(kind: Column, match: Column) -> Column:
    """The exact check of a wider match: what it would be in its plain form."""
    plain_ip = F.regexp_replace(match, r"[\[\]()]", "")
    return _by_kind(
        kind,
        {
            "email": match.rlike("[A-Za-z]{2,}$"),
            "ip": match.contains(":") | plain_ip.rlike(OCTETS),
            "card": sound("card", match),
            "phone": sound("phone", match),
        },
    )


@dataclass(frozen=True)
class Cut:
    """A text cut at the matches of a pattern: columns of its parts and its matches."""

    parts: str
    matches: str

    @staticmethod
    def add(df: DataFrame, text: str, pattern: str, needs: str, name: str) -> tuple[DataFrame, Cut]:
        none = F.array().cast("array<string>")
        able = F.col(text).rlike(needs)
        df = df.withColumns({
            f"{name}_parts": F.when(able, F.split(text, pattern, -1)).otherwise(none),
            f"{name}_matches": F.when(able, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none),
        })
        return df, Cut(f"{name}_parts", f"{name}_matches")

    def ends(self) -> Column:
        """Positions after every match, in code points."""
        lengths = F.zip_with(self.parts, self.matches, lambda part, match: F.length(part) + F.length(match))
        return running_sums(F.slice(lengths, F.lit(1), F.size(self.matches)))

    def masked(self, kind: str) -> Column:
        """The text with its sound matches blotted out, as long as before."""

        def piece(part: Column, match: Column) -> Column:
            mask = F.when(sound(kind, match), F.repeat(F.lit(MASK), F.length(match))).otherwise(match)
            return F.concat(part, F.coalesce(mask, F.lit("")))

        return F.array_join(F.zip_with(self.parts, self.matches, piece), "")


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, -1).when(for_, 1).otherwise(0)


def _gazetteer(kind: Column, match: Column) -> Column:
    number, low = digits(match), F.lower(match)
    return _by_kind(
        kind,
        {
            "email": _vote(low.rlike(rf"(?:^|[^a-z])(?:{DOMAINS})$"), low.rlike(rf"(?:^|[^a-z])(?:{FILES})$|[0-9]$")),
            "ip": _vote(match.rlike(HOSTS), match.rlike(NO_HOST)),
            "card": _vote(sound("card", match) & number.rlike(ISSUERS), ~sound("card", match)),
            "phone": _vote(match.rlike(rf"{DIAL_CODES}|{AREA_CODES}"), number.rlike(r"([0-9])\1{6}")),
        },
    )


def _context(kind: Column, left: Column) -> Column:
    return _vote(_by_kind(kind, {k: left.rlike(CUES[k]) for k in KINDS}), left.rlike(ANTI_CUES))


def _edges(left: Column, right: Column) -> Column:
    clear = left.rlike(r"(?:^|[\s(\[{<\"'“«,;:>|])$") & right.rlike(r"^(?:$|[\s)\]}>\"'”»,;:.!?<|])")
    return _vote(clear, left.rlike(r"[A-Za-z0-9_=/\\#$%&+-]$") | right.rlike(r"^[A-Za-z0-9_=/\\#$%&+-]"))


def _shape(match: Column) -> Column:
    found = F.lit("other")
    for name in reversed(WIDE):
        found = F.when(match.rlike(f"^(?:{WIDE[name]})$"), name).otherwise(found)
    return found


def _candidates(cut: Cut, kind: str | None) -> Column:
    """Structs of all matches of a cut; ``kind`` None for the wider shapes."""

    def candidate(match: Column, i: Column) -> Column:
        left = F.lower(F.right(F.element_at(cut.parts, i + 1), F.lit(NEAR)))
        right = F.substring(F.element_at(cut.parts, i + 2), 1, 1)
        shape = F.lit("base") if kind else _shape(match)
        of = F.lit(kind) if kind else F.element_at(F.create_map(*[F.lit(x) for p in SHAPE_KIND.items() for x in p]), shape)
        rule = F.when(sound(kind, match), 1).otherwise(-1) if kind else F.lit(0)
        good = sound(kind, match) if kind else _sound_wide(of, match)
        end = F.element_at(f"{cut.matches}_ends", i + 1)
        return F.struct(
            F.lit(bool(kind)).alias("base"), good.alias("sound"), of.alias("kind"),
            (end - F.length(match)).alias("start"), end.alias("end"),
            rule.cast("int").alias("rule"), _gazetteer(of, match).alias("gazetteer"),
            _context(of, left).alias("context"), _edges(left, right).alias("edges"),
            shape.alias("shape"), F.least(F.length(match) / 8, F.lit(5)).cast("int").alias("size"),
        )

    return F.transform(cut.matches, candidate)


def span_candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, candidates)`` of ``docs(doc_id, text)``, a row per row; written."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = {}
    for kind in KINDS:
        df, cuts[kind] = Cut.add(df, "text", BASE[kind], NEEDS[kind], kind)
    # the kinds' sound spans are blotted out one kind after the other
    df = df.withColumn("rest", F.col("text"))
    for kind in KINDS:
        df, cut = Cut.add(df, "rest", BASE[kind], NEEDS[kind], f"rest_{kind}")
        masked = F.when(F.size(cut.matches) > 0, cut.masked(kind)).otherwise(F.col("rest"))
        df = df.withColumn("rest", masked).drop(cut.parts, cut.matches)
    df, cuts["wide"] = Cut.add(df, "rest", WIDE_PATTERN, WIDE_NEEDS, "wide")
    df = df.drop("text", "rest")
    df = df.withColumns({f"{c.matches}_ends": c.ends() for c in cuts.values()})
    found = [_candidates(c, None if name == "wide" else name) for name, c in cuts.items()]
    return written(df.select("doc_id", F.concat(*found).alias("candidates")), "span_candidates")


def posterior(share: float, chances: list, votes: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(
        math.log(chances[j][1][v > 0] / chances[j][0][v > 0]) for j, v in enumerate(votes) if v
    )
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def reliabilities(patterns: Iterable[tuple[tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> tuple[float, list, dict]:
    """Share of true spans, vote chances by labeler and class, and posteriors by pattern.

    ``patterns`` are (votes, number). Dawid and Skene's estimate with two classes; an
    abstention says nothing. Beliefs keep the classes apart and weigh
    the same share at every size.
    """
    rows = list(patterns)
    total = sum(n for _, n in rows)
    labelers = len(rows[0][0]) if rows else 0
    share, chances = 0.5, [BELIEF for _ in range(labelers)]
    post: dict = {}
    for _ in range(rounds):
        post = {votes: posterior(share, chances, votes) for votes, _ in rows}
        weight = BELIEF_SHARE * total
        mass = {1: sum(n * post[v] for v, n in rows), 0: sum(n * (1 - post[v]) for v, n in rows)}
        share = (mass[1] + 0.5 * weight) / (total + weight)
        chances = []
        for j in range(labelers):
            of = {}
            for y in (0, 1):
                cast = [sum(n * (post[v] if y else 1 - post[v]) for v, n in rows if v[j] == vote) for vote in (-1, 1)]
                counted = [c + weight * belief for c, belief in zip(cast, BELIEF[y])]
                of[y] = tuple(c / sum(counted) for c in counted)
            chances.append(of)
    return share, chances, post


def fitted_weights(rows: list[tuple[dict, float, float]]) -> dict[tuple[str, str], float]:
    """Logistic regression on ``(features, soft label, number)``: a weight per feature value.

    Newton steps; the ridge keeps values seen in one class finite. Numbers enter as shares,
    so the fit is alike at every size.
    """
    names = sorted({(f, str(v)) for x, _, _ in rows for f, v in x.items()})
    place = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (features, _, _) in enumerate(rows):
        for f, v in features.items():
            x[i, place[f, str(v)]] = 1
    y = np.array([label for _, label, _ in rows])
    n = np.array([float(k) for _, _, k in rows])
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + RIDGE * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return {name: float(w[i]) for name, i in place.items()} | {("", ""): float(w[-1])}


def span_model(found: DataFrame) -> dict[str, dict[tuple[str, str], float]]:
    """Weights of the span classifier by kind, from the candidates of all documents.

    One aggregate by feature values; its rows are bounded by the product of their numbers.
    """
    spans = found.select(F.explode("candidates").alias("c")).select("c.kind", *[f"c.{f}" for f in FEATURES])
    counts = spans.groupBy("kind", *FEATURES).count().collect()
    model = {}
    for kind in KINDS:
        rows = [r for r in counts if r["kind"] == kind]
        if not rows:
            continue
        patterns: dict = {}
        for r in rows:
            votes = tuple(r[v] for v in VOTES)
            patterns[votes] = patterns.get(votes, 0) + r["count"]
        share, chances, post = reliabilities(sorted(patterns.items()))
        labelled = [({f: r[f] for f in FEATURES}, post[tuple(r[v] for v in VOTES)], r["count"]) for r in rows]
        # votes that the corpus does not show yet: every pattern once, with the share of the beliefs
        unseen = list(product((-1, 0, 1), repeat=len(VOTES)))
        each = BELIEF_SHARE * sum(patterns.values()) / len(unseen)
        labelled += [(dict(zip(VOTES, votes)), posterior(share, chances, votes), each) for votes in unseen]
        model[kind] = fitted_weights(sorted(labelled, key=repr))
    return model


def _probability(c: Column, model: dict) -> Column:
    pairs = [x for kind, weights in model.items() for (f, v), w in weights.items() for x in (F.lit(f"{kind}|{f}|{v}"), F.lit(w))]
    if not pairs:
        return F.lit(0.0)
    table = F.create_map(*pairs)

    def weight(*key: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws("|", c["kind"], *key)), F.lit(0.0))

    odds = weight(F.lit(""), F.lit(""))
    for f in FEATURES:
        odds = odds + weight(F.lit(f), c[f].cast("string"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(
        spans, lambda c: F.struct(F.element_at(rank, c["kind"]).alias("k"), c["start"].alias("s"), c["end"].alias("e"), c["kind"].alias("n"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda c: F.concat_ws(":", c["n"], c["s"], c["e"])), ",")


def find_spans(docs: DataFrame, added_from: float = ADDED_FROM) -> DataFrame:
    """Personal data of every row of ``docs(doc_id, text)``.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (sound base spans),
    ``base`` (them, as kind:start:end), ``spans`` (with the added ones) and ``n_added``.
    Positions are code points, the end exclusive. A null or empty text has no spans. Rows
    that repeat each other stay rows of their own. No documents give no rows. Extra columns
    are not looked at.
    """
    found = span_candidates(docs)
    model = span_model(found)
    base = F.filter("candidates", lambda c: c["base"] & c["sound"])
    added = F.filter("candidates", lambda c: ~c["base"] & c["sound"] & (_probability(c, model) >= added_from))
    of = found.select("doc_id", base.alias("sure"), added.alias("more"))

    def number(kind: str) -> Column:
        return F.size(F.filter("sure", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return of.select(
        "doc_id", *counts, _joined(F.col("sure")).alias("base"), _joined(F.concat("sure", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_added"),
    )
