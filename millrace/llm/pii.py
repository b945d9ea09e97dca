"""Personal data by candidate gradient boosting (operator 5), in DataFrame functions alone.

Base spans follow fixed patterns and checks. Beside them, high-recall generators, several for a kind, propose further
spans that may overlap: disguised addresses, national phone numbers, oddly grouped or short cards, version 6 and
disguised addresses of hosts, and secrets (passwords, tokens, keys), a kind that has no base pattern. Boosted trees, one
ensemble for a kind, score each by its format and its context; a logistic calibration turns the score into a
probability; a threshold per kind selects; of overlapping selected spans the likeliest stays.

The trees enter the plan as conditional expressions. They are fitted on the driver from sentences that ``examples``
makes up (see there), which pass the same generators and feature expressions: two parts in four fit the trees, one part
sets calibration and thresholds, and the last part is kept for ``measured``. No row of the table is learnt from.

Patterns are written so that no part of a text is scanned twice and none recurses per character: separators that can't
belong to a match are blanked first, one for one, so positions stay.

Edge cases: a null text is empty; empty texts have no span and the hash of the empty string; spans count code points;
repeated rows are judged one by one; an empty table gives an empty result. A table's own columns are carried whatever
their names are, except that ``pii_base`` and ``pii_spans`` are replaced; only the text is read.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Kinds in order, with their patterns; sizes and sums are checked after the match.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Separators that are in no match, and what stands for them. Dots are blanked outside of host names for e-mail (an
#: underscore may stand in the name, never in the host), lone separators for cards.
BLANK = {"email": (r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "_"), "card": (r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")}
#: What a text must hold for a pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: All kinds of spans, those without a base pattern last.
ALL = (*KINDS, "secret")

_DOT = r"(?:\x20?[(\[{<]\x20?(?:dot|punkt|point|punto|\.)\x20?[)\]}>]\x20?|\x20(?:dot|punkt|point|punto)\x20)"
_AT = r"(?:\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20)"
#: Generators of further candidates: kind, pattern, and the hint that a text must hold.
PROPOSE = (
    ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[a-z]{{2,24}}(?![a-z])){{1,4}}+", rf"(?i){_AT}[a-z0-9-]{{1,63}}(?:{_DOT}|\.)[a-z]{{2}}"),
    ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9_-]{{1,32}}+(?:{_DOT}[a-z0-9_-]{{1,32}}){{1,3}}{_AT}[a-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[a-z]{{2,24}}(?![a-z])){{1,4}}+", rf"(?i){_AT}[a-z0-9-]{{1,63}}(?:{_DOT}|\.)[a-z]{{2}}"),
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+\x20?@\x20?[\p{L}0-9-]{1,63}+(?:(?:\.|\x20\.\x20)[\p{L}]{2,24}+){1,4}+", "@"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::|::[0-9A-Fa-f]"),
    ("ip", rf"(?i)(?<![0-9A-Za-z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9A-Za-z])", rf"(?i)[0-9]{_DOT}[0-9]"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[.\x20-]{1,2}[0-9]{4,6}+){2}(?:[.\x20-]{1,2}[0-9]{3,7}+)?+(?![0-9A-Za-z])", r"[0-9]{4}[.\x20-]{1,2}[0-9]{4}"),
    ("card", r"(?<![0-9A-Za-z.,+-])[0-9]{13,15}+(?![0-9A-Za-z])", r"[0-9]{13}"),
    ("phone", r"(?<![0-9A-Za-z+.,:/-])(?:\([0-9]{2,5}\)|[0-9]{1,5}+)(?:[\x20./-]{1,2}[0-9]{2,8}+){1,5}+(?!\.?[0-9A-Za-z])", r"[0-9]\)?[\x20./-]{1,2}[0-9]{2}"),
    ("phone", r"(?<![0-9A-Za-z+.,:/-])[0-9]{8,13}+(?!\.?[0-9A-Za-z])", r"[0-9]{8}"),
    ("secret", r"(?i)(?<![a-z0-9])(?:password|passwort|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?key)\x20?(?:[:=]|\x20is\x20)\x20?[\"']?[^\s\"',;]{5,127}[^\s\"',;.!?)]", r"(?i)(?:passw|pwd|secret|token|key)[a-z]{0,6}\x20?(?:[:=]|\x20is\x20)"),
    ("secret", r"(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{30,40}|sk-[0-9A-Za-z]{20,64}|eyJ[0-9A-Za-z_-]{8,512}(?:\.[0-9A-Za-z_-]{8,512}){1,2})(?![0-9A-Za-z])", r"A[KS]IA[0-9A-Z]{16}|gh[opsu]_|sk-[0-9A-Za-z]|eyJ"),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])", r"[0-9a-f]{32}"),
)
#: Words near a candidate that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)mail|contact|write|reach|schreib|écri|correo|address|adresse", "ip": r"(?i)\bip\b|addr|host|server|login|client|ping",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|amex|paid", "phone": r"(?i)phone|\btel|call|mobil|fax|cell|ring|anruf|appel|llam|rufe|my number|telef|whatsapp|\bsms\b",
    "secret": r"(?i)passw|token|secret|key|login|credential|auth",
}
AGAINST = r"(?i)order|invoice|version|\bref\b|isbn|serial|price|total|\bid\b|\bno\b|page|score|date|\brow\b|lot|commit|sha|md5|hash|between|from|rev|build|bestell|seite|art\."
UNIT = r"(?i)^\x20?(?:%|km|kg|cm|eur|usd|euro|dollar|uhr|am\b|pm\b|pages|points|people|times|years|jahre|ans\b|€|\$)"
#: Names of the features, in the order of ``_features_sql``.
FEATURES = (
    "digits", "length", "spaces", "dots", "hyphens", "slashes", "colons", "parens", "groups", "first", "last", "longest", "shortest", "zero", "luhn",
    "marked", "year", "date", "double", "hex", "upper", "mixed", "domain", "handle", "for", "after", "against", "unit", "joined", "money", "named", "issued", "given",
)
#: Boosting rounds, step, least leaf, cuts tried for a feature, characters of context before and after, least precision of
#: a threshold, example sentences (a quarter of them kept for measuring).
ROUNDS, STEP, LEAF, CUTS, CONTEXT, PRECISION, SENTENCES = 40, 0.3, 8, 24, 28, 0.97, 4000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


#: Words of the made-up sentences: leads by kind, leads that speak against, fillers.
_LEAD = {
    "email": ("contact me by mail: ", "write to ", "my e-mail is ", "schreib an ", "mon adresse : ", "reach us under "),
    "ip": ("client ip address ", "server at ", "from host ", "login from ", "ping "),
    "card": ("paid with credit card ", "my visa ", "Kreditkarte ", "carte bancaire ", "card no ", "amex "),
    "phone": ("please call my phone ", "tel ", "Tel.: ", "my number is ", "Call me: ", "Telefon ", "appelez le ", "llame al ", "fax ", "phone ", "whatsapp ", "Anruf unter "),
    "secret": ("the login was ", "credentials: ", "use "),
}
_ODD = ("order no ", "invoice ", "version ", "ref ", "isbn ", "serial ", "page ", "lot ", "score ", "date ", "Seite ", "Bestellung ", "art. ", "build ", "commit ", "sha ")
_FILL = "the house was on a hill and they went there often der Hund lief weg und kam nie wieder la maison est petite el perro come mucho we saw it again near old trees".split()
_NAMES = "anna bert carla dirk elena frank john maria paul sofia".split()
_HOSTS = "gmail example web mail posteo company uni-bonn orange yahoo acme".split()
_TLDS = "com org net de fr es edu io info".split()


def _form(rng: random.Random) -> tuple[str, str, str, bool]:
    """A lead, a candidate, its kind, and whether it is personal."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    nz = lambda n: rng.choice("123456789") + d(n - 1)
    hx = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    fill = lambda: rng.choice(_FILL)
    none, odd = rng.choice(("", "and then there was ", "he said ", fill() + " ")), rng.choice(_ODD)
    kind = rng.choice(ALL)
    lead = rng.choice(_LEAD[kind])
    either = rng.choice((lead, none))
    if kind == "email":
        f, s, h, t = rng.choice(_NAMES), rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_TLDS)
        user = rng.choice((f + d(2), f"{f}.{s}", f"{f}_{s}", f"{f[0]}{s}{d(1)}", f))
        dot = rng.choice((" (dot) ", "[dot]", " dot ", "(.)", " [dot] ", " punkt "))
        at = rng.choice((" (at) ", "[at]", "(at)", " [at] ", " at ", " <at> ", "{at}", " (@) "))
        good = (f"{user}{at}{h}{dot}{t}", f"{f} dot {s} at {h} dot {t}", f"{f}[dot]{s}[at]{h}[dot]{t}", f"{user} @ {h}.{t}", f"{user}{rng.choice((' (at) ', '[at]'))}{h}.{t}", f"{f}ü{d(1)} @ {h}ö.{t}")
        bad = (f"{fill()} at {fill()} dot {fill()}", f"{fill()} at {fill()}.{fill()}", f"look at {h}.{t}", f"sign in at {h}.{t}", f"{fill()} @ {fill()}. {fill()}", f"the dot {fill()} at {fill()} dot {fill()}", f"meet at {fill()} point {fill()}")
        if rng.random() < 0.55:
            x = rng.choice(good)
            return (lead if x.startswith(f"{f} at ") else either), x, kind, True
        return rng.choice((none, odd)), rng.choice(bad), kind, False
    if kind == "ip":
        groups = [hx(rng.randint(1, 4)) for _ in range(8)]
        end = hx(rng.randint(1, 4))
        octet = lambda: str(rng.randint(0, rng.choice((9, 99, 255))))
        o, dot = [octet() for _ in range(4)], rng.choice((" dot ", "[.]", " [dot] ", "(dot)"))
        good = (":".join(groups), f"2001:db8::{end}", f"2a02:{hx(3)}:{hx(1)}::{end}", f"{hx(4)}::{end}", "fe80::" + ":".join(groups[: rng.randint(1, 4)]), f"{hx(4)}:{hx(4)}::{hx(4)}:{hx(3)}", dot.join(o))
        mac = ":".join(hx(2) for _ in range(6))
        bad = (f"{rng.randint(1, 12)}:{d(2)}:{d(2)}:{d(2)}", mac, f"{rng.randint(0, 9)}::{rng.randint(2, 5)}", f"::{rng.randint(1, 9)}", f"{rng.choice('abcdef')}dd::{rng.choice('abcdef')}ace", ":".join(hx(2) for _ in range(4)), f"1:{d(1)}:{d(1)}:{d(1)}")
        return (either, rng.choice(good), kind, True) if rng.random() < 0.5 else (rng.choice((none, odd)), rng.choice(bad), kind, False)
    if kind == "card":
        raw = rng.choice(("4", "5", "37", "6011")) + d(14)
        fix = lambda x, ok: next(x[:-1] + str(c) for c in range(10) if luhn(x[:-1] + str(c)) == ok)
        ok = rng.random() < 0.5
        n16, n15 = fix(raw[:15] + "0", ok), fix(raw[:14] + "0", ok)
        sep = rng.choice((".", "  ", ". ", " -", "--"))
        short = rng.random()
        if short < 0.6:
            x = sep.join(n16[k : k + 4] for k in range(0, 16, 4))
        elif short < 0.8:
            x = f"{n15[:4]}{rng.choice(' -.')}{n15[4:10]}{rng.choice(' -.')}{n15[10:]}"
        else:
            x = n15
        where = rng.choice((lead, lead, none, odd))
        return where, x, kind, ok and (where is lead or (short < 0.8 and where is none))
    if kind == "phone":
        good = (f"({nz(3)}) {d(3)}-{d(4)}", f"{nz(3)}-{d(3)}-{d(4)}", f"{nz(3)}.{d(3)}.{d(4)}", f"1-800-{d(3)}-{d(4)}", f"(0{d(2)}) {nz(6)}", f"0049 {nz(2)} {nz(7)}")
        local = (f"0{nz(2)} {nz(7)}", f"0{nz(2)}/{nz(6)}", f"0{nz(3)} {d(3)} {d(4)}", f"0{nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{nz(9)}", f"0{nz(3)}-{nz(6)}", nz(10), f"{nz(3)} {d(3)} {d(3)}", f"{nz(2)} {d(3)} {d(2)} {d(2)}")
        y, m, day = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
        bad = (f"{y}-{m:02d}-{day:02d}", f"{day:02d}.{m:02d}.{y}", f"{m:02d}/{day:02d}/{y}", f"{y}-{y + 5}", f"{y}/{y % 100:02d}", f"{nz(3)}.{d(3)}", f"{nz(2)} {d(2)}", f"978-{d(1)}{d(1)}-{d(6)}-{d(2)}", f"{nz(1)}.{d(2)}.{d(2)}", f"{nz(2)} {d(3)} {d(3)}", f"1.{d(3)}.000", f"{nz(2)}.{d(4)} {nz(2)}.{d(4)}", f"{nz(2)}-{d(2)} {nz(2)}-{d(2)}", f"{nz(3)}-{nz(3)}", nz(8), nz(12))
        r = rng.random()
        if r < 0.25:
            x = rng.choice(good)
            where = rng.choice((lead, none, odd))
            return where, x, kind, where is not odd or x.startswith("(")
        if r < 0.55:
            where = rng.choice((lead, lead, none, odd))
            return where, rng.choice(local), kind, where is lead
        where = rng.choice((none, odd, "between ", "from "))
        return where, rng.choice(bad), kind, False
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    word = rng.choice(("password", "passwd", "token", "api_key", "secret", "pwd", "Passwort", "access_key"))
    mixed = rng.choice((hx(18), hx(40), upper(5) + d(3) + hx(4), f"{fill()}{d(3)}!{d(2)}", f"{hx(4)}-{hx(6)}"))
    good = (f"{word}={mixed}", f'{word} = "{mixed}', f"{word}: {mixed}", f"AKIA{upper(16)}", "ghp_" + hx(36), "sk-" + hx(32), f"eyJ{hx(20)}.{hx(20)}.{hx(20)}")
    bad = (f"{word} is required", f"{word}: optional", f"{word} = value", f"{word} is stored", f"{word}: forgotten", f"{word}={'*' * 8}", f"{word} is important")
    r = rng.random()
    if r < 0.45:
        x = rng.choice(good)
        return rng.choice((lead, none)), x, kind, True
    if r < 0.6:
        where = rng.choice((lead, "commit ", "sha ", "md5 hash ", "build "))
        return where, hx(rng.choice((32, 40, 64))), kind, where is lead
    return none, rng.choice(bad), kind, False


def examples(n: int = SENTENCES, seed: int = 11) -> list[tuple[int, str, str, int, int, bool]]:
    """Made-up sentences: (number, text, kind, start, stop, personal), one form each, in four languages' words. Forms are
    those in which people write such data, and forms that look alike: dates, versions, times, ranges, prices, book and
    order numbers, program text, hashes."""
    rng, out = random.Random(seed), []
    for k in range(n):
        lead, x, kind, personal = _form(rng)
        before = " ".join(rng.choice(_FILL) for _ in range(rng.randint(0, 8)))
        before = before + rng.choice((". ", " ", ", ")) if before else ""
        after = rng.choice((".", ".", ",", "", ";", "\n", " ")) + rng.choice(("", " Then " + rng.choice(_FILL), " or " + rng.choice(_FILL)))
        if x.startswith(('password = "', 'token = "')) or ' = "' in x:
            after = '"' + after
        start = len(before + lead)
        out.append((k, before + lead + x + after, kind, start, start + len(x), personal))
    return out


_MODELS: dict[str, tuple] = {}


def _fit(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Boosted trees of depth two for the log loss: (feature, cut, (feature, cut, low, high) of both sides)."""
    cuts, binned = [], np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= CUTS else np.unique(middle[np.linspace(0, len(middle) - 1, CUTS).astype(int)]))
        binned[:, j] = np.searchsorted(cuts[j], x[:, j], side="left")
    margin, trees = np.zeros(len(y)), []

    def best(rows: np.ndarray, g: np.ndarray) -> tuple[int, float] | None:
        total, n = g[rows].sum(), len(rows)
        found, top = None, total**2 / max(1, n) + 1e-9
        for j, at in enumerate(cuts):
            left = np.cumsum(np.bincount(binned[rows, j], minlength=len(at) + 1))[:-1]
            sums = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=len(at) + 1))[:-1]
            fine = np.flatnonzero((left >= LEAF) & (left <= n - LEAF))
            if len(fine):
                gain = sums[fine] ** 2 / left[fine] + (total - sums[fine]) ** 2 / (n - left[fine])
                k = int(np.argmax(gain))
                if gain[k] > top:
                    found, top = (j, float(at[fine[k]])), gain[k]
        return found

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        value = lambda rows: float(STEP * g[rows].sum() / (h[rows].sum() + 1.0))  # noqa: B023, E731
        everything = np.arange(len(y))
        top = best(everything, g)
        if top is None:
            break
        sides = []
        for rows in (everything[x[:, top[0]] <= top[1]], everything[x[:, top[0]] > top[1]]):
            split = best(rows, g)
            if split is None:
                sides.append((None, 0.0, value(rows), value(rows)))
                margin[rows] += sides[-1][2]
            else:
                low, high = rows[x[rows, split[0]] <= split[1]], rows[x[rows, split[0]] > split[1]]
                sides.append((*split, value(low), value(high)))
                margin[low] += sides[-1][2]
                margin[high] += sides[-1][3]
        trees.append((*top, *sides))
    return trees


def _margins(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j, cut, *sides in trees:
        for side, rows in zip(sides, (x[:, j] <= cut, x[:, j] > cut), strict=True):
            k, c, low, high = side
            out[rows] += low if k is None else np.where(x[rows, k] <= c, low, high)
    return out


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression of the labels on the margin, slightly regularised."""
    slope, offset = 1.0, 0.0
    for _ in range(500):
        e = 1 / (1 + np.exp(-(slope * margin + offset))) - y
        slope -= 0.1 * float((e * margin).mean() + 0.01 * (slope - 1))
        offset -= 0.1 * float(e.mean())
    return slope, offset


def model(spark: SparkSession) -> dict[str, tuple[list[tuple], tuple[float, float], float]]:
    """By kind: trees, calibration (slope, offset) and the least probability. Fitted once per application."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        _MODELS[key] = _trained(spark)
    return _MODELS[key][0]


def measured(spark: SparkSession) -> dict[str, tuple[int, float, float]]:
    """By kind: personal forms, precision and recall on the example sentences that no part of the fit has seen."""
    model(spark)
    return _MODELS[spark.sparkContext.applicationId][1]


def _trained(spark: SparkSession) -> tuple[dict, dict]:
    made = examples()
    rows = spark.createDataFrame([(r[0], r[1]) for r in made], "number int, text string")
    found = _candidates(rows.withColumnRenamed("text", "pii_text")).select("number", "pii_c").collect()
    found = [(r.number, c) for r in found for c in r.pii_c]
    taken, tests = {}, {}
    for kind in ALL:
        mine = [(n, c) for n, c in found if c.kind == kind]
        x = np.array([c.f for _, c in mine], float).reshape(len(mine), len(FEATURES))
        gold = lambda n, c: made[n][2] == kind and made[n][5] and (c.start, c.stop) == made[n][3:5]  # noqa: B023, E731
        y, part = np.array([gold(n, c) for n, c in mine], float), np.array([n % 4 for n, _ in mine])
        trees = _fit(x[part < 2], y[part < 2])
        margin = _margins(trees, x)
        held = part == 2
        slope, offset = _calibrated(margin[held], y[held])
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        order = np.argsort(-p[held], kind="stable")
        ranked, hits = p[held][order], np.cumsum(y[held][order])
        fine = np.flatnonzero((hits / np.arange(1, len(hits) + 1) >= PRECISION) & (ranked >= 0.3))
        least = 0.9
        if len(fine):  # halfway to the next probability below
            k = int(fine[-1])
            least = float((ranked[k] + max(0.3, ranked[k + 1] if k + 1 < len(ranked) else 0.3)) / 2)
        taken[kind] = (trees, (slope, offset), least)
        test = part == 3
        chosen, wanted = (p >= least) & test, sum(1 for r in made if r[0] % 4 == 3 and r[2] == kind and r[5])
        tests[kind] = (wanted, float(y[chosen].sum() / max(1, chosen.sum())), float(y[chosen].sum() / max(1, wanted)))
    return taken, tests


def _luhn_sql(d: str) -> str:
    v = f"(ascii(substring({d}, i, 1)) - 48) * (1 + (length({d}) - i) % 2)"
    return f"(length({d}) > 0 AND aggregate(sequence(1, greatest(length({d}), 1)), 0, (s, i) -> s + {v} - CASE WHEN {v} > 9 THEN 9 ELSE 0 END) % 10 = 0)"


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _matches(df: DataFrame, name: str, text: str, pattern: str, hint: str) -> DataFrame:
    """Adds array column ``name`` of struct(start, stop, m): the pattern's leftmost non-overlapping matches."""
    holds = f"contains({text}, {_quote(hint)})" if hint.isalnum() or hint == "@" else f"{text} RLIKE {_quote(hint)}"
    kind = "array<struct<start:int,stop:int,m:string>>"
    df = df.withColumn(f"{name}_m", F.expr(f"CASE WHEN {holds} THEN regexp_extract_all({text}, {_quote(pattern)}, 0) ELSE cast(array() as array<string>) END"))
    df = df.withColumn(f"{name}_g", F.expr(f"CASE WHEN size({name}_m) > 0 THEN split({text}, {_quote(pattern)}, -1) ELSE cast(array() as array<string>) END"))
    begin = f"s.at + char_length({name}_g[i])"
    step = f"named_struct('at', {begin} + char_length({name}_m[i]), 'out', concat(s.out, array(named_struct('start', {begin}, 'stop', {begin} + char_length({name}_m[i]), 'm', {name}_m[i]))))"
    all_ = f"aggregate(sequence(0, size({name}_m) - 1), named_struct('at', 0, 'out', cast(array() as {kind})), (s, i) -> {step}, s -> s.out)"
    return df.withColumn(name, F.expr(f"CASE WHEN size({name}_m) > 0 THEN {all_} ELSE cast(array() as {kind}) END")).drop(f"{name}_m", f"{name}_g")


#: Checks of a base match x.
CHECK = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255)",
    "card": f"length(regexp_replace(x.m, '[ -]', '')) BETWEEN 16 AND 19 AND {_luhn_sql(chr(100))}".replace("length(d)", "length(regexp_replace(x.m, '[ -]', ''))").replace("substring(d,", "substring(regexp_replace(x.m, '[ -]', ''),"),
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 8 AND 15",
}


def _based(df: DataFrame) -> DataFrame:
    """Adds ``pii_base`` to a frame with ``pii_text``."""
    for kind in KINDS:
        source = "pii_text"
        if kind in BLANK:
            pattern, stand_in = BLANK[kind]
            holds = F.col("pii_text").contains("@") if kind == "email" else F.col("pii_text").rlike(HINT[kind])
            df = df.withColumn(f"pii_{kind}_text", F.when(holds, F.regexp_replace("pii_text", pattern, stand_in)).otherwise(F.lit("")))
            source = f"pii_{kind}_text"
        df = _matches(df, f"pii_{kind}", source, BASE[kind], HINT[kind])
        df = df.withColumn(f"pii_{kind}", F.expr(f"transform(filter(pii_{kind}, x -> {CHECK[kind]}), x -> named_struct('k', {KINDS.index(kind)}, 'kind', '{kind}', 'start', x.start, 'stop', x.stop))"))
        df = df.drop(f"pii_{kind}_text")
    return df.withColumn("pii_base", F.concat(*[f"pii_{k}" for k in KINDS])).drop(*[f"pii_{k}" for k in KINDS])


def _features_sql(kind: str) -> str:
    """``FEATURES`` of x: start, stop, m (match), b and a (text before and after), d (digits of m), g (their groups)."""
    flag = lambda sql: f"CASE WHEN {sql} THEN 1.0D ELSE 0.0D END"
    like = lambda what, pattern: flag(f"{what} RLIKE {_quote(pattern)}")
    number = lambda sql: f"cast({sql} as double)"
    count = lambda cls: number(f"length(regexp_replace(x.m, {_quote('[^' + cls + ']')}, ''))")
    return "array(" + ", ".join([
        number("length(x.d)"), number("char_length(x.m)"), count(r"\x20"), count("."), count(r"\-"), count("/"), count(":"), count("()"),
        number("size(x.g)"), number("coalesce(get(x.g, 0), 0)"), number("coalesce(get(x.g, size(x.g) - 1), 0)"), number("coalesce(array_max(x.g), 0)"), number("coalesce(array_min(x.g), 0)"),
        like("x.d", "^0"), flag(_luhn_sql("x.d")), like("x.m", r"(?i)[(\[{<]\x20?(?:at|dot|@|\.)\x20?[)\]}>]"), like("x.m", "(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"),
        like("x.m", r"^(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{2,4}|[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2})$"), flag("contains(x.m, '::')"), count("A-Fa-f"), count("A-Z"),
        like("x.m", r"(?=.{0,128}[=:\x20\"][^=:\x20\"]{0,128}[0-9])(?=.{0,128}[A-Za-z])|^[0-9A-Za-z_-]{16}"), like("x.m", r"(?i)(?:\.|dot[)\]}>]?|point|punkt|punto)\x20?(?:com|org|net|de|fr|es|edu|io|info)$"),
        like("x.m", r"^[^\s@(\[{<]*[0-9._][^\s@(\[{<]*\x20?[@(\[{<a]"), like("x.b", FOR[kind]), like("x.a", FOR[kind]), like("x.b", AGAINST), like("x.a", UNIT),
        like("x.b", r"(?i)(?:\bdot|\bpunkt|\bpoint|\bpunto|[(\[{<.)\]}>])\x20?$"), like("x.b", r"[$€£#]\x20?$"), like("x.m", r"(?i)^(?:look|sign|log|see|meet|in|be|me|us|it|stay|stayed|arrive|page|sat|was)\x20"),
        like("x.m", "^(?:A[KS]IA|gh[opsu]_|sk-|eyJ)"), like("x.m", "[=:]|\x20is\x20"),
    ]) + ")"


def _candidates(df: DataFrame) -> DataFrame:
    """Adds ``pii_base`` and ``pii_c``, the proposed spans that no base span overlaps: k, kind, start, stop, f."""
    df = _based(df)
    for n, (kind, pattern, hint) in enumerate(PROPOSE):
        df = _matches(df, f"pii_g{n}", "pii_text", pattern, hint)
    for kind in ALL:
        mine = [f"pii_g{n}" for n, p in enumerate(PROPOSE) if p[0] == kind]
        every = f"array_distinct(concat({', '.join(mine)}))"
        free = "NOT exists(pii_base, o -> o.start < x.stop AND x.start < o.stop)"
        digits = "regexp_replace(x.m, '[^0-9]', '')"
        groups = "transform(filter(split(x.m, '[^0-9]+'), z -> z <> ''), z -> length(z))"
        context = f"named_struct('start', x.start, 'stop', x.stop, 'm', x.m, 'd', {digits}, 'g', {groups}, 'b', substring(pii_text, greatest(x.start - {CONTEXT}, 0) + 1, least(x.start, {CONTEXT})), 'a', substring(pii_text, x.stop + 1, {CONTEXT}))"
        featured = f"transform(transform(filter({every}, x -> {free}), x -> {context}), x -> named_struct('k', {ALL.index(kind)}, 'kind', '{kind}', 'start', x.start, 'stop', x.stop, 'f', {_features_sql(kind)}))"
        empty = "cast(array() as array<struct<k:int,kind:string,start:int,stop:int,f:array<double>>>)"
        df = df.withColumn(f"pii_c_{kind}", F.expr(f"CASE WHEN {' + '.join(f'size({m})' for m in mine)} > 0 THEN {featured} ELSE {empty} END"))
    return df.withColumn("pii_c", F.concat(*[f"pii_c_{k}" for k in ALL])).drop(*[f"pii_c_{k}" for k in ALL], *[f"pii_g{n}" for n in range(len(PROPOSE))])


def _score_sql(trees: list[tuple]) -> str:
    """Margin of the trees over the features z.f."""

    def side(s: tuple) -> str:
        k, cut, low, high = s
        return f"{low!r}D" if k is None else f"CASE WHEN z.f[{k}] <= {cut!r}D THEN {low!r}D ELSE {high!r}D END"

    return " + ".join(f"(CASE WHEN z.f[{j}] <= {cut!r}D THEN {side(low)} ELSE {side(high)} END)" for j, cut, low, high in trees) or "0D"


def _kept_sql(model_: dict) -> str:
    """Spans of ``pii_c`` over their kind's threshold, the likeliest of overlapping ones, longer ones first among equals."""
    odds = " ".join(f"WHEN z.k = {ALL.index(kind)} THEN {slope!r}D * ({_score_sql(trees)}) + {offset!r}D" for kind, (trees, (slope, offset), _) in model_.items())
    least = " ".join(f"WHEN z.k = {ALL.index(kind)} THEN {bar!r}D" for kind, (_, _, bar) in model_.items())
    scored = f"transform(pii_c, z -> named_struct('k', z.k, 'kind', z.kind, 'start', z.start, 'stop', z.stop, 'p', 1D / (1D + exp(-(CASE {odds} END)))))"
    over = f"filter({scored}, z -> z.p >= CASE {least} END)"
    order = "(a, b) -> CASE WHEN a.p <> b.p THEN (CASE WHEN a.p > b.p THEN -1 ELSE 1 END) WHEN a.stop - a.start <> b.stop - b.start THEN b.stop - b.start - a.stop + a.start WHEN a.k <> b.k THEN a.k - b.k ELSE a.start - b.start END"
    plain = "named_struct('k', x.k, 'kind', x.kind, 'start', x.start, 'stop', x.stop)"
    return f"aggregate(array_sort({over}, {order}), cast(array() as array<struct<k:int,kind:string,start:int,stop:int>>), (s, x) -> CASE WHEN exists(s, o -> o.start < x.stop AND x.start < o.stop) THEN s ELSE concat(s, array({plain})) END)"


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``pii_text``, ``pii_base`` and ``pii_spans``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = _candidates(docs.select(whole, F.coalesce(F.col(text_col), F.lit("")).alias("pii_text")))
    by_place = "(a, b) -> CASE WHEN a.k <> b.k THEN a.k - b.k WHEN a.start <> b.start THEN a.start - b.start ELSE a.stop - b.stop END"
    spans = f"CASE WHEN size(pii_c) > 0 THEN array_sort(concat(pii_base, {_kept_sql(model(docs.sparkSession))}), {by_place}) ELSE pii_base END"
    return df.withColumn("pii_spans", F.expr(spans)).drop("pii_c")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of struct(k, kind, start, stop), by kind as listed, then start."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("pii_base", "pii_spans")]
    return _found(docs, text_col).select(*own, "pii_base", "pii_spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one."""
    by_start = "(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.stop - a.stop END"
    step = "CASE WHEN x.start >= s.at THEN named_struct('at', x.stop, 'out', concat(s.out, array(substring(pii_text, s.at + 1, x.start - s.at), concat('[', upper(x.kind), ']')))) ELSE named_struct('at', greatest(s.at, x.stop), 'out', s.out) END"
    whole = f"aggregate(array_sort(pii_spans, {by_start}), named_struct('at', 0, 'out', cast(array() as array<string>)), (s, x) -> {step}, s -> array_join(concat(s.out, array(substring(pii_text, s.at + 1))), ''))"
    cleaned = F.when(F.size("pii_spans") > 0, F.expr(whole)).otherwise(F.col(f"row.`{text_col}`"))
    return _found(docs, text_col).select(*[cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', cast(x.start as string), ':', cast(x.stop as string))), ',')")


def op5(spark, sf_dir: str) -> DataFrame:
    df = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(pii_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("pii_base"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans"))
