"""Personal data, in DataFrame operations only: base patterns, and candidates judged by boosted trees.

Patterns mark their matches with control characters, so that splitting at the marks gives the
places in code points.  Base spans are always taken.  High-recall generators propose further,
possibly overlapping spans of the same kinds (telephone numbers without a plus, spelled-out
addresses, cards with other separators, spaced-out IPs); features of format and context go into
gradient-boosted trees, and a threshold for each kind selects those that count.

No table labels personal data, so trees are fitted on made-up examples, hard lookalikes among them (an
octet too large, a failing check digit, the number of a section or a part), and calibrated on examples
of other sentences, words and names: of a grid of thresholds the lowest is taken that the exact binomial
bound proves to keep the precision.  Fitting runs on the driver in plain Python, on features that are
the same as the columns'; nothing of the corpus comes there.  All lists are built in time that grows
with their length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from segrank.llm.common import require
from segrank.llm.quality import proven

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms of them take the same matches in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer digits are dropped anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates: kind and pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+ ?\. ?[0-9]{1,3}+ ?\. ?[0-9]{1,3}+ ?\. ?[0-9]{1,3}+(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2,7}+"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\(0?[0-9]{2,4}\)|0?[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+.@_/-])[0-9]{10,11}(?![0-9A-Za-z@_/-]|\.[0-9])"),
)
#: What a text has that a generator can find anything in, one for each generator.
LIKELY = (r"(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]++(?: ?[\[(] ?dot| dot |\.[A-Za-z0-9])", r"[0-9] ?\. ?[0-9]", r"[0-9]{4}[./_][0-9]{4}", r"[0-9)][ .-][0-9]{3}", r"[0-9]{10}")
#: Words near a span that speak for its kind, and words right before it that speak against it.
CONTEXT = {"email": "mail|contact|write|reach", "ip": "ip|host|addr|server|gateway|ping", "card": "card|visa|amex|payment|credit|debit|master", "phone": "phone|tel|call|fax|mobile|cell|whatsapp|ring|dial"}
CONTRA = {"email": "see|visit|page|site", "ip": "section|chapter|version|release|item|clause|figure|step|rev", "card": "serial|code|isbn|order|track|batch|sku|ref", "phone": "model|part|total|sum|row|ref|order|serial|invoice|isbn|in|of"}
#: Domains, and words before "at" that make a sentence rather than an address.
TLD = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|ca|eu|nl|ch|br|mx|au|jp|ru|pl|se|dk|fi|pt|ie|nz|dev|app"
VERBS = "look|looks|looked|meet|met|arrive|arrived|stay|stayed|is|are|was|were|be|me|us|him|them|it|not|only|start|starts|ends|stop|work|here|there|back|up|out|point|available|not"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?: ?\. ?0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Whether the parts are set apart alike.
EVEN = {"email": r"[\[(] ?at ?[\])]| at .* dot ", "ip": r"^[0-9]+(\.| \. )[0-9]+\1[0-9]+\1[0-9]+$", "card": r"^[0-9]+([./_])[0-9]+\1[0-9]+\1[0-9]+$", "phone": r"^(?:\([0-9]+\)[ ]?|[0-9]+([ .-]))[0-9]+(?:\1|[ .-])[0-9]+$"}
TOP_LEVEL, VERB, BEFORE, AFTER, LABEL, BRACKETS = rf"(?i)(?:\.|dot[\])]? ?)(?:{TLD})$", rf"(?i)^(?:{VERBS})[ \[(]", r"[\w.$#*/-]", r"[\w$%#*/-]", r"[:=] ?$", r"[\[(]"
NEAR, CLOSE = 24, 12
FEATURES = ("digits", "length", "spaces", "brackets", "luhn", "octets", "context", "contra", "before", "after", "label", "tld", "verb", "even")
#: Made-up examples of each kind to fit and to calibrate, trees, and the precision that is proven at the error, over all kinds and thresholds.
FIT, CALIBRATE, TREES, DEPTH, PRECISION, ERROR, SEED = 800, 1600, 16, 3, 0.98, 0.05, 20260101
#: Thresholds that are tried, as probabilities.
GRID = (0.5, 0.6, 0.7, 0.8, 0.9)
#: Entries of a list before the next one is begun; see collect().
FULL = 256
_SPAN = "struct<start:int,end:int,rank:int,s:string>"
_PLAIN = "struct<start:int,end:int,rank:int>"


def collect(items: Column, kind: str, state: list[Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """What step(state, item) makes, as ARRAY<kind>, in time that grows with its length: it is put into short lists, which are joined at the end.

    ``state``: aliased columns; step gives their new values by name, whether there is an entry, and the entry.
    """
    none = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def merge(acc: Column, x: Column) -> Column:
        new, there, entry = step(acc, x)
        full = F.size(acc["cur"]) >= FULL
        cur = F.when(there, F.when(full, F.array(entry)).otherwise(F.concat(acc["cur"], F.array(entry)))).otherwise(acc["cur"])
        done = F.when(there & full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(*(c.alias(n) for n, c in new.items()), cur.alias("cur"), done.alias("done"))

    return F.aggregate(items, F.struct(*state, none[0].alias("cur"), none[1].alias("done")), merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))


def _marked(text: Column, pattern: str) -> Column:
    """Text pieces; every second one is a match."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02")), "[\x01\x02]")


def _spans(pieces: str, kind: str) -> Column:
    """ARRAY<STRUCT<start, end, rank, s>> of the matches among pieces."""
    def step(acc: Column, piece: Column) -> tuple:
        end = acc["at"] + F.length(piece)
        return {"at": end, "is": ~acc["is"]}, acc["is"], F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), piece.alias("s"))

    return collect(F.col(pieces), _SPAN, [F.lit(0).alias("at"), F.lit(False).alias("is")], step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes; every second digit from the right is doubled."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """Adds _t (the text, its own mark characters replaced one for one), _d (whether it has a digit) and _base: sorted base spans."""
    df = df.withColumn("_t", F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01\x02", "\x06\x06"))
    df = df.withColumn("_d", F.col("_t").rlike("[0-9]"))  # most texts have no digit, and need no other pattern
    tests = {"email": F.instr("_t", "@") > 0, "ip": F.col("_d") & F.col("_t").rlike(r"[0-9]\.[0-9]"), "card": F.col("_d") & F.col("_t").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.col("_d") & (F.instr("_t", "+") > 0)}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        df = df.withColumn(f"_p_{kind}", F.when(tests[kind], _marked(F.col("_t"), pattern)))
    for kind in KINDS:
        df = df.withColumn(f"_s_{kind}", F.when(F.size(f"_p_{kind}") > 1, _spans(f"_p_{kind}", kind)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))).drop(f"_p_{kind}")
    count = lambda x: F.length(_digits(x["s"]))
    df = df.withColumns({
        "_s_ip": F.filter("_s_ip", lambda x: x["s"].rlike(OCTETS)),
        "_s_card": F.filter("_s_card", lambda x: F.when(count(x).between(14, 19), _luhn(_digits(x["s"]))).otherwise(False)),
        "_s_phone": F.filter("_s_phone", lambda x: count(x).between(10, 15)),
    })
    df = df.withColumns({f"n_{k}": F.size(f"_s_{k}").cast("long") for k in KINDS})
    return df.withColumn("_base", F.array_sort(F.concat(*(f"_s_{k}" for k in KINDS)))).drop(*(f"_s_{k}" for k in KINDS))


def _apart(df: DataFrame) -> DataFrame:
    """_cand without proposals that touch a base span: one scan forward past base spans that begin before, one backward."""
    flat = lambda c, is_base: F.struct(c["start"].alias("start"), F.lit(not is_base).alias("cand"), c["end"].alias("end"), c["rank"].alias("rank"), c["s"].alias("s"))
    kind = "struct<start:int,cand:boolean,end:int,rank:int,s:string>"
    both = F.array_sort(F.concat(F.transform("_base", lambda c: flat(c, True)), F.transform("_cand", lambda c: flat(c, False))))
    ahead = collect(both, kind, [F.lit(0).alias("at")], lambda acc, x: ({"at": F.when(x["cand"], acc["at"]).otherwise(F.greatest(acc["at"], x["end"]))}, ~x["cand"] | (x["start"] >= acc["at"]), x))
    back = collect(F.reverse(ahead), _SPAN, [F.lit(2**31 - 1).alias("at")], lambda acc, x: ({"at": F.when(x["cand"], acc["at"]).otherwise(F.least(acc["at"], x["start"]))}, x["cand"] & (x["end"] <= acc["at"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["s"].alias("s"))))
    return df.withColumn("_cand", F.when((F.size("_base") > 0) & (F.size("_cand") > 0), back).otherwise(F.col("_cand")))


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds _cand: proposals that touch no base span, with their features."""
    for i, (kind, pattern) in enumerate(GENERATORS):
        able = F.lit(True) if kind == "email" else F.col("_d")
        df = df.withColumn(f"_g{i}", F.when(able & F.col("_t").rlike(LIKELY[i]), _marked(F.col("_t"), pattern)))
    for i, (kind, _) in enumerate(GENERATORS):
        df = df.withColumn(f"_g{i}", F.when(F.size(f"_g{i}") > 1, _spans(f"_g{i}", kind)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")))
    names = [f"_g{i}" for i in range(len(GENERATORS))]
    df = _apart(df.withColumn("_cand", F.concat(*names)).drop(*names))

    def features(c: Column) -> Column:
        digits = _digits(c["s"])
        near = F.lower(F.substring(F.col("_t"), F.greatest(c["start"] - NEAR + 1, F.lit(1)), F.least(c["start"], F.lit(NEAR))))
        before = F.when(c["start"] == 0, "").otherwise(F.substring(F.col("_t"), c["start"], F.lit(1)))
        after = F.substring(F.col("_t"), c["end"] + 1, F.lit(1))
        one = lambda x: x.cast("int")
        by_kind = lambda make: reduce(lambda a, k: F.when(c["rank"] == KINDS.index(k), one(make(k))).otherwise(a), KINDS, F.lit(0))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"), F.length(digits).alias("digits"), F.length(c["s"]).alias("length"), (F.length(c["s"]) - F.length(F.translate(c["s"], " ", ""))).alias("spaces"),
            one(c["s"].rlike(BRACKETS)).alias("brackets"), F.when(F.length(digits).between(14, 19), one(_luhn(digits))).otherwise(0).alias("luhn"), one(c["s"].rlike(OCTETS)).alias("octets"),
            by_kind(lambda k: near.rlike(rf"(?<![a-z])(?:{CONTEXT[k]})")).alias("context"), by_kind(lambda k: F.right(near, F.lit(CLOSE)).rlike(rf"(?<![a-z])(?:{CONTRA[k]})")).alias("contra"),
            one(before.rlike(BEFORE)).alias("before"), one(after.rlike(AFTER)).alias("after"), one(near.rlike(LABEL)).alias("label"), one(c["s"].rlike(TOP_LEVEL)).alias("tld"), one(c["s"].rlike(VERB)).alias("verb"), by_kind(lambda k: c["s"].rlike(EVEN[k])).alias("even"))

    return df.withColumn("_cand", F.transform("_cand", features))


def plain_features(text: str, start: int, end: int, rank: int) -> list[int]:
    """The features of one proposal, for fitting; the same as the columns of with_candidates()."""
    s, kind = text[start:end], KINDS[rank]
    digits, near = re.sub("[^0-9]", "", s), text[max(0, start - NEAR) : start].lower()
    luhn = 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
    found = lambda p, x: int(re.search(p, x, re.A) is not None)
    return [
        len(digits), len(s), s.count(" "), found(BRACKETS, s), int(luhn), found(OCTETS, s), found(rf"(?<![a-z])(?:{CONTEXT[kind]})", near), found(rf"(?<![a-z])(?:{CONTRA[kind]})", near[-CLOSE:]),
        found(BEFORE, text[start - 1 : start] if start else ""), found(AFTER, text[end : end + 1]), found(LABEL, near), found(TOP_LEVEL, s), found(VERB, s), found(EVEN[kind], s),
    ]


#: Sentences, words and names of the examples; those to calibrate share none with those to fit.
TO_FIT = {
    "cue": {"email": ("mail ", "contact: ", "please write to "), "ip": ("ip ", "the host ", "server: "), "card": ("card ", "visa: ", "payment by "), "phone": ("call ", "phone: ", "tel ", "call me on ")},
    "bare": ("", "and then ", "it said ", "as noted, "), "tail": ("", " now", " ok.", ", thanks", " today"),
    "contra": {"ip": ("section ", "item ", "release ", "in version "), "card": ("serial ", "code ", "isbn "), "phone": ("phone model ", "part ", "a total of ", "rows ", "the ref ")},
    "name": ("ann", "j.doe", "info", "sales"), "site": ("example", "mail-box", "corp"), "tld": ("com", "org", "de"), "verb": ("we met", "look", "they are", "it is"), "place": ("noon", "home", "the office", "work"), "end": ("sharp", "then", "we", "the"),
}
TO_CALIBRATE = {
    "cue": {"email": ("my e-mail is ", "reach us: ", "Contact "), "ip": ("ping ", "address ", "Gateway: "), "card": ("credit: ", "my mastercard is ", "amex "), "phone": ("fax ", "mobile: ", "my cell is ", "WhatsApp ")},
    "bare": ("", "so he wrote ", "there was ", "the note reads "), "tail": ("", " please", " soon.", "; bye", " (new)"),
    "contra": {"ip": ("chapter ", "clause ", "step ", "see figure "), "card": ("order ", "tracking ", "batch "), "phone": ("serial ", "order ", "sum ", "invoice ")},
    "name": ("maria", "k_smith", "office", "bob.lee"), "site": ("sample", "web-host", "firm"), "tld": ("net", "fr", "edu"), "verb": ("she arrived", "all were", "starts", "wait for me"), "place": ("dawn", "lunch", "school", "seven"), "end": ("precisely", "and", "if", "pm"),
}


def examples(words: dict, each: int, seed: int = SEED) -> list[tuple[str, int, int]]:
    """(text, rank, 1 if personal): ``each`` texts of a kind, half of them lookalikes. A fixed number, whatever the corpus."""
    r = random.Random(seed)
    pick = r.choice
    d = lambda n: "".join(pick("0123456789") for _ in range(n))
    out = []

    def add(kind: str, good: int, lead: str, core: str) -> None:
        out.append((lead + core + pick(words["tail"]), KINDS.index(kind), good))

    def octets(low: int, high: int, sep: str) -> str:
        return sep.join(str(r.randrange(low, high if low or high < 100 or r.random() < 0.6 else 10)) for _ in range(4))

    def card(passing: bool) -> str:
        base = pick("3456") + d(14)
        last = -sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(base))) % 10
        n, sep = base + str(last if passing else (last + r.randrange(1, 10)) % 10), pick("./_")
        return sep.join((n[:4], n[4:8], n[8:12], n[12:]))

    def phone(sep: str, ten: bool = True) -> str:
        return sep.join((d(3), d(3), d(4))) if ten else sep.join((d(pick((2, 3))), d(3), d(3)))

    for i in range(each):
        cue = lambda k: pick(words["cue"][k])
        free = lambda k: pick((cue(k), cue(k), pick(words["bare"])))
        name, site, tld = pick(words["name"]), pick(words["site"]), pick(words["tld"])
        at, dot = pick((" [at] ", " (at) ", "(at)", "[at]")), pick((" [dot] ", " dot ", "(dot)", "."))
        if i % 2:
            add("email", 1, *pick(((free("email"), f"{name}{at}{site}{dot}{tld}"), (cue("email"), f"{name} at {site} dot {tld}"), (pick(words["bare"]), f"{name} at {site} dot {tld}"))))
            add("ip", 1, free("ip"), octets(0, 256, " . "))
            add("card", 1, free("card"), card(True))
            sep = pick(" .-")
            add("phone", 1, *pick(((free("phone"), f"({d(3)}) {d(3)}{pick('-. ')}{d(4)}"), (cue("phone"), phone(sep)), (cue("phone"), d(10)))))
        else:
            add("email", 0, *pick(((f"{pick(words['verb'])}{at}{pick(words['place'])}.", pick(words["end"])), (f"{pick(words['verb'])} at {pick(words['place'])}.", pick(words["end"])), (pick(words["bare"]) + pick(words["verb"]), f" at {site}.{tld}"), (cue("email"), f"{name}{at}{pick(words['place'])}.{pick(words['end'])}"), (cue("email"), f"us at {site} dot {pick(words['end'])}"))))
            add("ip", 0, *pick(((free("ip"), octets(256, 1000, pick((".", " . ")))), (free("ip"), f"{octets(0, 256, ' . ').rpartition(' . ')[0]} . {r.randrange(256, 999)}"), (pick(words["contra"]["ip"]), octets(0, pick((20, 256)), pick((". ", " . ")))), (free("ip"), octets(0, pick((20, 256)), ". ")), (pick(words["bare"]) + "v", octets(0, pick((20, 256)), " . ")))))
            add("card", 0, *pick(((free("card"), card(False)), (pick(words["contra"]["card"]), card(True)), (pick(words["contra"]["card"]), card(False)))))
            sep = pick(" .-")
            add("phone", 0, *pick(((pick(words["contra"]["phone"]), phone(sep)), (pick(words["contra"]["phone"]), d(pick((10, 11)))), (pick(words["bare"]), phone(" ", False)), (free("phone"), phone(sep, False)), (pick(words["bare"]), d(pick((10, 11)))), (pick(words["bare"]), phone(sep)), (cue("phone") + "$", phone(sep)))))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rank) of what the generators propose in one text."""
    return [(m.start(), m.end(), KINDS.index(k)) for k, p in GENERATORS for m in re.finditer(p, text, re.A)]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.4) -> list[tuple]:
    """Trees of DEPTH splits (feature, cut, left, right) under the logistic loss, each side a split or a leaf weight."""
    score, out = np.zeros(len(y)), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        top = (1e-9, -1, 0.0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                if gain > top[0] + 1e-9:
                    top = (gain, f, float(cut))
        return top

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        gain, f, cut = best(rows, g, h) if depth and len(rows) > 4 else (0, -1, 0.0)
        if f < 0:
            w = round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
            score[rows] += w
            return w
        return f, cut, grow(rows[x[rows, f] <= cut], g, h, depth - 1), grow(rows[x[rows, f] > cut], g, h, depth - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
    return out


def _weight(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def measured(made: list[tuple[str, int, int]], rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of the proposals of one kind in examples; a proposal is personal if its example is."""
    rows = [(plain_features(t, a, b, k), y) for t, own, y in made if own == rank for a, b, k in proposals(t) if k == rank]
    return np.array([x for x, _ in rows], float), np.array([y for _, y in rows], float)


_models: dict[tuple, dict] = {}


def train(precision: float = PRECISION, error: float = ERROR, seed: int = SEED) -> dict[int, tuple[list, float]]:
    """Trees and threshold by kind, the same in every session: less than a second for fixed examples.

    Raises if the precision of a kind can't be proven at any threshold.
    """
    key = (precision, error, seed)
    if key not in _models:
        fit, held, model = examples(TO_FIT, FIT, seed), examples(TO_CALIBRATE, CALIBRATE, seed + 1), {}
        for k, kind in enumerate(KINDS):
            trees = boost(*measured(fit, k))
            x, y = measured(held, k)
            scores = np.array([sum(_weight(t, row) for t in trees) for row in x])
            for p in GRID:
                cut = float(np.log(p / (1 - p)))
                taken = scores >= cut
                if proven(int(taken.sum()), int((taken & (y == 0)).sum()), 1 - precision, error / len(GRID) / len(KINDS)):
                    model[k] = (trees, cut)
                    break
            else:
                raise ValueError(f"no threshold proves a precision of {precision} for {kind}")
        _models[key] = model
    return _models[key]


def _chosen(model: dict[int, tuple[list, float]]) -> str:
    """SQL text, one parse for all trees: whether the candidate c reaches its kind's threshold."""
    def of(t) -> str:
        return f"{t!r}D" if not isinstance(t, tuple) else f"if(c.{FEATURES[t[0]]} <= {t[1]!r}D, {of(t[2])}, {of(t[3])})"

    return "CASE c.rank " + " ".join(f"WHEN {k} THEN {' + '.join(map(of, trees))} >= {cut!r}D" for k, (trees, cut) in model.items()) + " ELSE false END"


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _base and _all: sorted arrays of (start, end, rank); _all are the base spans and the selected candidates, without overlaps among these."""
    model = train()
    df = with_candidates(with_base(docs, text_col))

    plain = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"))
    df = df.withColumn("_cand", F.array_sort(F.transform(F.expr(f"filter(_cand, c -> {_chosen(model)})"), plain)))
    # a span stays if it begins behind the last one kept
    first = collect(F.col("_cand"), _PLAIN, [F.lit(0).alias("at")], lambda acc, c: ({"at": F.when(c["start"] >= acc["at"], c["end"]).otherwise(acc["at"])}, c["start"] >= acc["at"], c))
    return df.withColumn("_base", F.transform("_base", plain)).withColumn("_all", F.array_sort(F.concat("_base", F.when(F.size("_cand") > 1, first).otherwise(F.col("_cand"))))).drop("_cand")


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all) for each row of ``docs``.

    Places are code points, ends exclusive. Null and empty texts have no spans; an empty table gives no rows; texts of
    any length are read whole; of candidates that overlap the first and shortest stays; repeated rows get a row each;
    extra columns aren't read, whatever their names.
    """
    require(docs, id_col, text_col)
    df = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    return df.select(F.col("_id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


#: Code points of the blocks that a text is cut into, so that a place is found without reading from the start.
BLOCK = 4096


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, as in <email>; of overlapping spans the first names the kind.

    Null texts stay null; rows, repeated ones too, stay each; other columns stay as they are, whatever their names.
    """
    require(docs, text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"), F.col(text_col).alias("_text"))
    df = with_spans(whole, "_text")
    kinds = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    blocks = F.regexp_extract_all(F.col("_text"), F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(b: Column, start: Column, end: Column) -> Column:
        """Text from start up to end: the rest of its first block, whole blocks, the beginning of its last one."""
        i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        head = F.coalesce(F.substring(F.get(b, i), start % BLOCK + 1, F.when(i == j, end - start).otherwise(F.lit(BLOCK))), F.lit(""))
        rest = F.concat(F.array_join(F.slice(b, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(b, j), F.lit(1), end % BLOCK), F.lit("")))
        return F.when(i == j, head).otherwise(F.concat(head, rest))

    def step(acc: Column, s: Column) -> tuple:
        there = s["start"] >= acc["at"]
        return {"at": F.greatest(acc["at"], s["end"]), "b": acc["b"]}, there, F.concat(between(acc["b"], acc["at"], s["start"]), F.coalesce(F.get(kinds, s["rank"]), F.lit("")))

    end = F.length("_text")
    last = F.array(F.struct(end.alias("start"), end.alias("end"), F.lit(len(KINDS)).alias("rank")))  # of no kind: what follows the last span
    new = F.array_join(collect(F.concat("_all", last), "string", [F.lit(0).alias("at"), blocks.alias("b")], step), "")
    df = df.withColumn("_new", F.when(F.size("_all") > 0, new).otherwise(F.col("_text")))
    return df.select(*(F.col("_new").alias(c) if c == text_col else F.col(f"_whole.`{c}`").alias(c) for c in docs.columns))
