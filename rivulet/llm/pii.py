"""Personal data in whole texts: exact base patterns and model-selected candidates, with native expressions.

Base spans are leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (13 to 19 digits passing the
Luhn check) and phone (+, 9 to 15 digits). Beyond these, generators of high recall propose overlapping spans (numbers set
out like telephone numbers, spelled-out addresses, social security numbers, account numbers, IPv6 addresses). Gradient
boosted trees score each proposal by its format and its context, and each kind's calibrated threshold selects. Of selected
proposals that overlap each other the one that lies highest above its threshold stays. The trees are fitted at planning time on labelled phrases that a
seeded rule writes, and run as CASE expressions; no Python runs on executors.

Patterns use possessive quantifiers and start only where a run of their characters starts (or where the last match ended),
which finds the same matches as the plain patterns but in linear time and constant stack, whatever the text. Offsets are code
points, end exclusive; they are running sums of the lengths between matches, in chunks of 1,024 matches. Contexts and what
redaction keeps are cut from pieces of 256 code points, so the work is linear in the text and in the number of spans.

Defined cases: a null text is empty (and stays null in `redact`); rows are handled one by one, so repeated and null ids stay;
an empty table gives no rows; texts of any length are searched whole; columns of any name are passed through by `redact` and
come back in `doc` from `detect`.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns, as fixed by the contract, written so that they match in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals: name, pattern, and a character without which there is no match.
PROPOSALS = {
    "tel": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9A-Za-z])",
    "mail_text": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[A-Za-z0-9-]++)++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
NEEDS = {"email": "@", "phone": "+"}
KINDS = [*BASE, *PROPOSALS]
#: Words before a span that speak for personal data. Fixed values.
CUES = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|reach|write|ssn|social|security|iban|account|bank|transfer|address|host|server|login)"
CHUNK = 1024
SPANS = "array<struct<kind:int,start:int,end:int,text:string>>"
PLACES = "array<struct<start:int,end:int,kind:int>>"
CONTEXT = 24
PIECE = 256
#: Stands for characters of base spans; no proposal can hold it.
MASK = "\u0001"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body speaks of it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), 0)


def _chunked(items: Column) -> Column:
    """An array cut into arrays of CHUNK, in which sequential steps may copy what they have."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def _at(text: Column, kind: str, pattern: str, found: Column) -> Column:
    """Array of (kind, start, end, text) of the matches found."""
    sizes = F.zip_with(F.split(text, pattern, -1), found, lambda b, f: F.struct(F.length(b).alias("gap"), F.coalesce(F.length(f), F.lit(0)).alias("own"), f.alias("text")))
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x["gap"] + x["own"])
    starts = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))

    def spans(c: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = F.when(F.size(acc) == 0, base).otherwise(F.try_element_at(acc, F.lit(-1))["end"]) + x["gap"]
            return F.concat(acc, F.array(let(start, lambda at: F.struct(F.lit(KINDS.index(kind)).alias("kind"), at.alias("start"), (at + x["own"]).alias("end"), x["text"].alias("text")))))

        return F.aggregate(c, F.array().cast(SPANS), step)

    placed = lambda cs: let(starts(cs), lambda at: F.flatten(F.zip_with(cs, F.slice(at, 1, F.size(cs)), spans)))
    return let(F.slice(sizes, 1, F.size(found)), lambda pieces: let(_chunked(pieces), placed))


def _ends_before(spans: Column) -> Column:
    """For each span the largest end of all before it, 0 for the first."""
    largest = lambda c: F.array_max(F.transform(c, lambda x: x["end"]))
    heads = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), largest(c)))))

    def run(c: Column, head: Column) -> Column:
        start = F.struct(head.alias("m"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(c, start, lambda acc, x: F.struct(F.greatest(acc["m"], x["end"]).alias("m"), F.concat(acc["out"], F.array(acc["m"])).alias("out")))["out"]

    return let(_chunked(spans), lambda cs: let(heads(cs), lambda m: F.flatten(F.zip_with(cs, F.slice(m, 1, F.size(cs)), run))))


def _groups(spans: Column, body) -> Column:
    """body(s, first, next, ends) over the groups of overlapping spans of the sorted array s; ends: as of _ends_before, and at
    last the largest of all."""

    def over(s: Column, ends: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= F.get(ends, i))
        return let(begins, lambda b: F.transform(b, lambda i, k: body(s, i, F.coalesce(F.get(b, k + 1), F.size(s)), ends)))

    last = lambda s: F.array(F.array_max(F.transform(s, lambda x: x["end"])))
    return let(F.array_sort(spans), lambda s: let(F.concat(_ends_before(s), last(s)), lambda ends: over(s, ends)))


def _merged(spans: Column) -> Column:
    """Overlapping spans (start, end, kind) as one, of the first's kind."""
    one = lambda s, i, after, ends: F.struct(F.get(s, i)["start"].alias("start"), F.get(ends, after).alias("end"), F.get(s, i)["kind"].alias("kind"))
    return _groups(spans, one)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places, from the pieces that hold it."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, end - start)


def _replaced(pieces: Column, length: Column, merged: Column, by) -> Column:
    """The text with by(span) in the place of each of the merged spans."""

    def whole(m: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(m, k - 1)["end"])
        kept = F.transform(m, lambda x, k: F.concat(_cut(pieces, before(k), x["start"]), by(x)))
        return F.concat(F.array_join(kept, ""), _cut(pieces, F.element_at(m, -1)["end"], length))

    return let(merged, whole)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return text.rlike(rf"^(?:{part}|0++)(?:\.(?:{part}|0++)){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["text"])


# Features of a proposal, each as (native expression, the same in Python); x has kind and text, before and after are context.
FEATURES = {
    "kind": (lambda x, b, a: x["kind"], lambda k, t, b, a: k),
    "length": (lambda x, b, a: F.length(x["text"]), lambda k, t, b, a: len(t)),
    "digits": (lambda x, b, a: F.length(F.regexp_replace(x["text"], "[^0-9]", "")), lambda k, t, b, a: len(re.sub("[^0-9]", "", t))),
    "kinds_of_digit": (lambda x, b, a: F.size(F.array_distinct(F.split(F.regexp_replace(x["text"], "[^0-9]", ""), ""))), lambda k, t, b, a: len(set(re.sub("[^0-9]", "", t))) or 1),
    "marks": (lambda x, b, a: F.length(F.regexp_replace(x["text"], "[A-Za-z0-9 ]", "")), lambda k, t, b, a: len(re.sub("[A-Za-z0-9 ]", "", t))),
    "spaces": (lambda x, b, a: F.length(F.regexp_replace(x["text"], "[^ ]", "")), lambda k, t, b, a: t.count(" ")),
    "spelled": (lambda x, b, a: x["text"].rlike(r"[(\[]at[)\]]|[(\[]dot[)\]]| dot ").cast("int"), lambda k, t, b, a: int(bool(re.search(r"[(\[]at[)\]]|[(\[]dot[)\]]| dot ", t)))),
    "void": (lambda x, b, a: x["text"].rlike(r"^(?:000|666|9..)-|-00-|-0000$").cast("int"), lambda k, t, b, a: int(bool(re.search(r"^(?:000|666|9..)-|-00-|-0000$", t)))),
    "year_first": (lambda x, b, a: x["text"].rlike(r"^(?:19|20)[0-9]{2}[ ./-]").cast("int"), lambda k, t, b, a: int(bool(re.search(r"^(?:19|20)[0-9]{2}[ ./-]", t)))),
    "cue": (lambda x, b, a: b.rlike(CUES).cast("int"), lambda k, t, b, a: int(bool(re.search(CUES, b)))),
    "number_before": (lambda x, b, a: b.rlike(r"[0-9$%#.,/]\s*$").cast("int"), lambda k, t, b, a: int(bool(re.search(r"[0-9$%#.,/]\s*$", b)))),
    "number_after": (lambda x, b, a: a.rlike(r"^\s*[0-9%$#/]").cast("int"), lambda k, t, b, a: int(bool(re.search(r"^\s*[0-9%$#/]", a)))),
}


def phrases(n: int = 900, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled proposals (kind, text, before, after, label) written by rule: personal data in its usual settings, and numbers
    and words of the same shape in other ones."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstl") for _ in range(r.randint(2, 8)))
    sep = lambda: r.choice("-. ")
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        kind = r.choice(list(PROPOSALS))
        cue = r.choice(["call me at ", "phone: ", "my tel ", "contact ", "fax ", "mobile no. ", "reach us on "]) if kind == "tel" else r.choice(["write to ", "mail ", "contact me: ", "reach me "]) if kind == "mail_text" else r.choice(["ssn ", "social security number ", "his ssn: "]) if kind == "ssn" else r.choice(["iban ", "bank transfer to ", "account "]) if kind == "iban" else r.choice(["host ", "login from ", "address ", "server "])
        plain = r.choice([f"{word()} {word()} ", f"{word()}, ", "", f"{word()} of "])
        before = cue if good and r.random() < 0.85 else plain if good else r.choice([plain, plain, f"{word()} {d(2)}.", f"total {d(3)} ", "$ ", "no. # "])
        after = r.choice(["", ".", ", " + word(), " " + word()]) if good or r.random() < 0.5 else r.choice([" " + d(3), "%", "/" + d(2), " " + word()])
        if kind == "tel":
            s = sep()
            text = (f"({d(3)}) {d(3)}-{d(4)}" if r.random() < 0.4 else f"{r.randint(200, 989)}{s}{d(3)}{s}{d(4)}") if good else r.choice([f"{r.choice(['19', '20'])}{d(2)}-{d(3)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(3)}", f"000{s}000{s}0000"])
        elif kind == "mail_text":
            text = r.choice([f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]org", f"{word()} at {word()} dot net", f"{word()}.{word()} (at) {word()}.com"]) if good else r.choice([f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word()}", f"{word()} at the. {word()}"])
        elif kind == "ssn":
            text = f"{r.choice([r.randint(100, 665), r.randint(667, 899)])}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if good else r.choice([f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-0000", f"{d(3)}-{d(2)}-{d(4)}"])
            before = before if good or "-0" in text or text[0] in "09" else f"part no. {d(1)}#"
        elif kind == "iban":
            text = f"{r.choice(['DE', 'FR', 'ES', 'GB', 'IT'])}{d(2)} " + " ".join(d(4) for _ in range(4)) + r.choice([" " + d(2), ""]) if good else r.choice([f"{r.choice(['AB', 'XX', 'NR'])}{d(2)}" + "".join(r.choice("ABCDEFGHXYZ") for _ in range(12)), f"NO{d(2)} " + " ".join("".join(r.choice("ABCDEFGH") for _ in range(4)) for _ in range(3))])
        else:
            text = ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)) if good else ":".join(d(2) for _ in range(r.randint(5, 6)))
        out.append((kind, text, before[-CONTEXT:], after[:CONTEXT], int(good)))
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees of two levels on numeric features: (feature, cut, then (feature, cut, left, right) of both sides), and a threshold
    for each kind of proposal."""

    trees: tuple
    start: float
    thresholds: dict[str, float]

    def margin(self, row: dict[str, float]) -> float:
        total = self.start
        for f, cut, low, high in self.trees:
            g, c, a, b = low if row[f] <= cut else high
            total += a if row[g] <= c else b
        return total

    def native(self, row: Column) -> Column:
        total = F.lit(self.start)
        for f, cut, low, high in self.trees:
            leaf = [F.when(row[g] <= c, F.lit(a)).otherwise(F.lit(b)) for g, c, a, b in (low, high)]
            total = total + F.when(row[f] <= cut, leaf[0]).otherwise(leaf[1])
        return total


@lru_cache(1)
def fit(rounds: int = 24, rate: float = 0.4, precision: float = 0.97) -> Boosted:
    """Boosting on the logistic loss; a third of the phrases is kept to calibrate each kind's threshold for the precision asked."""
    data = [({n: float(f[1](KINDS.index(k), t, b, a)) for n, f in FEATURES.items()}, y) for k, t, b, a, y in phrases()]
    train, check = [x for i, x in enumerate(data) if i % 3], [x for i, x in enumerate(data) if i % 3 == 0]
    share = sum(y for _, y in train) / len(train)
    start = math.log(share / (1 - share))
    margin, trees = [start] * len(train), []
    cuts = {f: sorted({r[f] for r, _ in train})[:-1] for f in FEATURES}
    cuts = {f: c if len(c) <= 16 else [c[k * len(c) // 16] for k in range(16)] for f, c in cuts.items() if c}

    def split(rows: list[int], grad: list[float], hess: list[float]) -> tuple:
        best = (-1.0, next(iter(cuts)), 0.0, 0.0, 0.0)
        for f, at in cuts.items():
            for c in at:
                g = [0.0, 0.0]
                h = [1.0, 1.0]
                for i in rows:
                    side = train[i][0][f] > c
                    g[side] += grad[i]
                    h[side] += hess[i]
                gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
                if gain > best[0]:
                    best = (gain, f, c, g[0] / h[0], g[1] / h[1])
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [y - q for (_, y), q in zip(train, p, strict=True)], [q * (1 - q) for q in p]
        _, f, cut, _, _ = split(list(range(len(train))), grad, hess)
        sides = []
        for high in (False, True):
            _, g, c, a, b = split([i for i, (r, _) in enumerate(train) if (r[f] > cut) == high], grad, hess)
            sides.append((g, c, rate * a, rate * b))
        trees.append((f, cut, *sides))
        for i, (r, _) in enumerate(train):
            g, c, a, b = sides[r[f] > cut]
            margin[i] += a if r[g] <= c else b
    model, thresholds = Boosted(tuple(trees), start, {}), {}
    for kind in PROPOSALS:
        scored = sorted(((model.margin(r), y) for r, y in check if r["kind"] == KINDS.index(kind)), reverse=True)
        good, thresholds[kind] = 0, scored[0][0]
        for k, (m, y) in enumerate(scored, 1):
            good += y
            if good >= precision * k and m > 0:
                thresholds[kind] = m
    return Boosted(tuple(trees), start, thresholds)


def detect(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc (all columns, as a struct), base and spans: arrays of (kind, start, end), kinds as in KINDS, in order."""
    model = model or fit()
    text = F.col("whole")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("whole"))
    none = F.array().cast(SPANS)
    digit = text.rlike("[0-9]")
    rows = rows.withColumn("digit", digit)
    gates = {k: text.contains(NEEDS[k]) if k in NEEDS else F.col("digit") for k in KINDS}
    gates["mail_text"] = text.rlike(r"(?:\(at\)|\[at\]| at )")
    patterns = BASE | PROPOSALS
    rows = rows.select("doc", "whole", *[F.when(gates[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("doc", "whole", *[F.when(F.size(f"m_{k}") > 0, _at(text, k, p, F.col(f"m_{k}"))).otherwise(none).alias(k) for k, p in patterns.items()])
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.concat(*[F.transform(F.filter(k, _checked(k)), plain) for k in BASE])
    rows = rows.select("doc", "whole", base.alias("base"), F.concat(*PROPOSALS).alias("proposed"))
    by_start = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    limits = F.array(*[F.lit(model.thresholds.get(k, math.inf)) for k in KINDS])

    def scored(x: Column, pieces: Column) -> Column:
        before, after = _cut(pieces, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"]), _cut(pieces, x["end"], x["end"] + CONTEXT)
        features = let(F.struct(before.alias("b"), after.alias("a")), lambda c: F.struct(*[f[0](x, c["b"], c["a"]).cast("double").alias(n) for n, f in FEATURES.items()]))
        over = let(features, lambda f: model.native(f) - F.get(limits, x["kind"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), over.alias("over"))

    def best(s: Column, first: Column, after: Column, ends: Column) -> Column:
        """Of overlapping proposals the one furthest over its threshold, then what does not overlap the ones taken."""
        ranked = F.array_sort(F.transform(F.slice(s, first + 1, after - first), lambda x: F.struct((-x["over"]).alias("rank"), by_start(x).alias("x"))))
        clear = lambda taken, x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        add = lambda taken, r: F.when(clear(taken, r["x"]), F.concat(taken, F.array(r["x"]))).otherwise(taken)
        return F.when(after - first == 1, F.array(by_start(F.get(s, first)))).otherwise(F.aggregate(ranked, F.array().cast(PLACES), add))

    # Proposals that overlap a base span go; the base spans are told by a copy of the text in which they are masked.
    mask = lambda pieces: _replaced(pieces, F.length(text), _merged(F.transform("base", by_start)), lambda x: F.repeat(F.lit(MASK), x["end"] - x["start"]))
    free = lambda found: let(_pieces(let(_pieces(text), mask)), lambda masked: F.filter(found, lambda x: ~_cut(masked, x["start"], x["end"]).contains(MASK)))
    open_ = F.when(F.size("base") == 0, F.col("proposed")).otherwise(free(F.col("proposed")))
    rows = rows.select("doc", "whole", "base", F.when(F.size("proposed") > 0, open_).otherwise(none).alias("proposed"))
    chosen = let(_pieces(text), lambda pieces: F.filter(F.transform("proposed", lambda x: scored(x, pieces)), lambda x: x["over"] >= 0))
    nothing = F.array().cast(PLACES)
    rows = rows.select("doc", "base", F.when(F.size("proposed") > 0, chosen).alias("chosen"))
    added = F.when(F.coalesce(F.size("chosen"), F.lit(0)) > 0, F.flatten(_groups(F.col("chosen"), best))).otherwise(nothing)
    return rows.select("doc", "base", F.array_sort(F.concat("base", F.transform(added, plain))).alias("spans"))


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    found = detect(docs, model)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    places = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    clean = let(_pieces(F.col("doc.text")), lambda pieces: _replaced(pieces, F.length("doc.text"), _merged(places), lambda x: F.get(names, x["kind"])))
    clean = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(clean)
    return found.select(*[clean.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
