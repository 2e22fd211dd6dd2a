"""Personal data by candidates and boosted trees, in SQL functions throughout.

Base kinds are found by fixed patterns and always stay: ``email``, ``ip``, ``card`` (Luhn) and ``phone``. Besides,
generators of high recall propose spans that may overlap: ``number`` (seven digits or more, however grouped),
``contact`` (addresses spelled with "at" and "dot"), ``secret`` (a value after a word like password), ``key`` (long runs
of letters and digits: access keys, bearer and signed tokens), ``iban``, ``ipv6``, ``address`` (a house number and
capitalised words) and ``name`` (capitalised words after a title or an introduction). Boosted trees on the span's format
and on the words around it give each a log-odds, which is calibrated to a probability on held-out examples (a logistic
curve of it); a span is selected if that is above its kind's threshold, the lowest of the precision asked for there. A
proposed span that overlaps a base one isn't kept, as the base one stands for it. Names without such a word before them
aren't proposed.

The trees are fitted on the driver to a fixed number of generated examples (``EXAMPLES``), whose features are made by
the same SQL functions, and then written out as CASE expressions.

Positions count code points from 0, ends exclusive. Where a pattern below differs from the plain one in its comment, it
finds the same matches but never rescans a run of characters.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "contact", "secret", "key", "iban", "ipv6", "address", "name")

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

NUMBER = r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
CONTACT = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\bat\b)\x20?[A-Za-z0-9-]++"
    r"(?:(?:\x20?(?:\(dot\)|\[dot\]|\bdot\b)\x20?|\.)[A-Za-z0-9-]++)++"
)
SECRET = (
    r"(?i)(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?[^\s\x22']{4,}"
)

#: Runs of 16 or more with a digit and a letter among the first 64, dots between them as in signed tokens.
KEY = r"(?<![A-Za-z0-9_.+/-])(?=[A-Za-z0-9_-]{16})(?=[0-9_-]{0,64}[A-Za-z])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]{8,}+)*+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"
ADDRESS = r"(?<![0-9A-Za-z.,-])[0-9]{1,5}[a-z]?\x20(?:[A-Z][a-z]++\x20){0,3}[A-Z][a-z]++(?![A-Za-z])|(?<![A-Za-z])[A-Z][a-zäöüß]++(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}(?![0-9])"
NAME = (
    r"(?=[A-Z][a-z])(?<=[a-z'.:]\x20)(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.?\x20|\b[Nn]ame(?:\x20is|:)\x20|\bI\x20am\x20|\bI'm\x20|\b[Cc]ontact:?\x20|\b[Dd]ear\x20)"
    r"[A-Z][a-zà-ÿ]++(?:[\x20-](?:[A-Z]\.\x20)?[A-Z][a-zà-ÿ]++){0,2}"
)

_SPAN = "array<struct<start:int,stop:int,value:string>>"
_BLOCK = 256


def spans(text: Column, pattern: str, may: Column | None = None) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of ``start``, ``stop``, ``value``.

    The text between matches and the matches themselves alternate, so their lengths add up to the positions. They are
    added in blocks, which keeps texts with very many matches cheap. ``may``: a cheap test that all matches imply.
    """
    test = text.rlike(pattern) if may is None else may & text.rlike(pattern)

    def positions(pieces: Column) -> Column:
        n = F.size(pieces)
        lengths = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + F.char_length(x["gap"]) + F.char_length(x["value"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(pieces, b * _BLOCK + 1, _BLOCK))
        return _let(
            blocks,
            lambda bs: _let(
                F.transform(bs, lengths),
                lambda sums: F.flatten(
                    F.transform(
                        bs,
                        lambda part, b: F.aggregate(
                            part,
                            F.struct(
                                F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x).alias("at"),
                                F.array().cast(_SPAN).alias("out"),
                            ),
                            lambda acc, x: F.struct(
                                (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("at"),
                                F.concat(
                                    acc["out"],
                                    F.array(
                                        F.struct(
                                            (acc["at"] + F.char_length(x["gap"])).alias("start"),
                                            (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("stop"),
                                            x["value"].alias("value"),
                                        )
                                    ),
                                ).alias("out"),
                            ),
                            lambda acc: acc["out"],
                        ),
                    )
                ),
            ),
        )

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = _let(
        values,
        lambda v: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)).alias("gap"), v.alias("value")),
    )
    return F.when(test, _let(pieces, positions)).otherwise(F.array().cast(_SPAN))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.char_length(d)),
            F.lit(0),
            lambda acc, i: acc + _let(d.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        )

    return (F.char_length(digits) > 0) & (_let(F.reverse(digits), total) % 10 == 0)


def iban_remainder(value: Column) -> Column:
    """The remainder by 97 of an account number, its first four signs put last and letters as 10 to 35: 1 if it is valid."""
    plain = F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))

    def remainder(x: Column) -> Column:
        turned = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
        step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.coalesce(step(acc, c), acc)))

    return _let(plain, remainder)


def base_spans(text: Column) -> dict[str, Column]:
    octet = lambda x: _number(x) <= 255
    return {
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), octet)),
        "card": F.filter(spans(text, CARD), lambda s: luhn(_digits(s["value"]))),
        "phone": F.filter(spans(text, PHONE, text.contains("+")), lambda s: F.char_length(_digits(s["value"])).between(10, 15)),
    }


def _number(x: Column) -> Column:
    """The value of a run of digits; 999 if it has over three beside leading zeros."""
    return _let(F.ltrim(x, F.lit("0")), lambda y: F.when(y == "", 0).when(F.char_length(y) > 3, 999).otherwise(y.try_cast("int")))


def candidates(text: Column) -> dict[str, Column]:
    return {
        "number": spans(text, NUMBER),
        "contact": spans(text, CONTACT),
        "secret": spans(text, SECRET, text.contains("=") | text.contains(":")),
        "key": spans(text, KEY),
        "iban": spans(text, IBAN),
        "ipv6": spans(text, IPV6, text.contains(":")),
        "address": spans(text, ADDRESS),
        "name": spans(text, NAME),
    }


CONTEXT = 32
FEATURES = (
    "length", "n_digits", "n_letters", "n_separators", "groups", "luhn", "phone_word", "id_word", "other_word", "telephone_form",
    "ssn_form", "date_form", "spelled", "value_length", "value_digits", "value_upper", "repeated", "switches", "key_form",
    "key_word", "hexadecimal", "iban_remainder", "colons", "empty_groups", "street_word", "name_word", "capitals", "uuid_form",
)


def features(text: Column, s: Column) -> Column:
    """Format and context features of one span, as an array of doubles in the order of ``FEATURES``."""
    value = s["value"]
    before = F.lower(text.substr(F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    after = F.lower(text.substr(s["stop"] + 1, F.lit(CONTEXT)))
    tail = F.regexp_replace(value, r"^[^:=]*[:=]\s*[\x22']?", "")
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    has = lambda x, p: x.rlike(p).cast("int")
    out = (
        F.char_length(value), count(value, "[0-9]"), count(value, "[A-Za-z]"), count(value, r"[\x20().-]"), count(value, "[0-9]+"),
        luhn(_digits(value)).cast("int"),
        has(before, r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b[^0-9a-z]{0,4}(?:\w{1,3}\W)?\s*$"),
        has(before, r"\b(?:ssn|social security|passport|tax id|national id|account|iban|licen[cs]e|insurance)\b[^.!?\n]{0,16}$"),
        F.greatest(has(before, r"\b(?:isbn|order|invoice|item|part|version|page|serial|ticket|total|sum|code)\b[^.!?\n]{0,12}$"), has(after, r"^\s*(?:items|pieces|people|times|euros?|dollars?|units|bytes|rows)\b")),
        has(value, r"^(?:1[\x20.-])?\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$"),
        has(value, r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        has(value, r"^(?:[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4})"),
        has(value, r"(?i)(?:\(at\)|\[at\]|(?:\(|\[|\b)dot\b)"),
        F.char_length(tail), count(tail, "[0-9]"), count(tail, "[A-Z]"),
        (F.char_length(F.regexp_replace(_digits(value), r"(.)(?=\1)", "")) * 2 <= count(value, "[0-9]")).cast("int"),
        count(value, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        has(value, r"^(?:sk|pk|rk)_(?:live|test)_|^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[opsur]_|^github_pat_|^xox[abprs]-|^glpat-|^AIza|^ya29\.|^eyJ[A-Za-z0-9_-]+\.|^npm_|^hf_|^SG\."),
        has(before, r"\b(?:bearer|token|secret|key|credentials?|authorization|auth|jwt)\b[^.!?\n]{0,12}$"),
        has(value, r"^[0-9a-fA-F]+$"),
        _let(value, iban_remainder), count(value, ":"), count(value, "::"),
        has(value, r"\b(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Square|Terrace|Close)$|(?:straße|strasse|weg|platz|gasse)\b"),
        has(before, r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sra)\.?|\bname(?: is|:))\x20$"),
        count(value, r"\b[A-Z]"),
        has(value, r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
    )
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in out])


# --- boosted trees


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


#: Thresholds that are tried for a feature: so many quantiles of it.
_CUTS = 19


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0.05, 0.95, _CUTS)).round(3)) for column in x.T]


def _grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float) -> Node:
    """A tree on features given as numbers of the cuts below them; leaves are Newton steps, splits keep 5 on either side."""
    node = Node(rate * gradient.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(codes) < 20:
        return node
    n_features, width = codes.shape[1], _CUTS + 1
    place = (codes + np.arange(n_features) * width).reshape(-1)
    sums = lambda w: np.bincount(place, None if w is None else np.repeat(w, n_features), n_features * width).reshape(n_features, width).cumsum(1)
    n, g, h = sums(None), sums(gradient), sums(weight)
    gain = g**2 / (h + 1.0) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1.0) - gradient.sum() ** 2 / (weight.sum() + 1.0)
    gain[(n < 5) | (n > len(codes) - 5)] = -1
    feature, cut = divmod(int(gain.argmax()), width)
    if gain[feature, cut] <= 1e-6:
        return node
    low = codes[:, feature] <= cut
    node.feature, node.at = feature, float(cuts[feature][cut])
    node.low = _grow(codes[low], cuts, gradient[low], weight[low], depth - 1, rate)
    node.high = _grow(codes[~low], cuts, gradient[~low], weight[~low], depth - 1, rate)
    return node


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, _value(node.low, x), _value(node.high, x))


def _as_sql(node: Node, x: str) -> str:
    if node.low is None:
        return f"{float(node.value)!r}D"
    return f"CASE WHEN {x}[{node.feature}] <= {node.at!r}D THEN {_as_sql(node.low, x)} ELSE {_as_sql(node.high, x)} END"


@dataclass
class Model:
    """Trees of one kind, the curve that makes their log-odds a calibrated probability, and the threshold of that."""

    trees: list[Node]
    slope: float
    offset: float
    threshold: float

    def sql(self, x: str) -> str:
        """The calibrated probability that the span with the features ``x`` is personal."""
        total = " + ".join(_as_sql(t, x) for t in self.trees) or "0D"
        return f"1 / (1 + exp(-(({total}) * {self.slope!r}D + {self.offset!r}D)))"

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(sum(_value(t, x) for t in self.trees) * self.slope + self.offset)))


def _curve(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of most likelihood, its targets smoothed by the numbers of either label."""
    positive = y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    ab, x = np.array([1.0, 0.0]), np.stack([score, np.ones(len(score))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ ab)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        ab += step / max(1.0, np.abs(step).max())
    return float(ab[0]), float(ab[1])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4, precision: float = 0.98) -> Model:
    """Logistic gradient boosting on two thirds; curve and threshold are set on the rest."""
    if not len(x):
        return Model([], 1.0, 0.0, float("inf"))
    rest = np.arange(len(x)) % 3 == 2
    xa, ya, score, trees = x[~rest], y[~rest], np.zeros((~rest).sum()), []
    cuts = _cuts(xa)
    codes = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, xa.T)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(codes, cuts, ya - p, p * (1 - p), depth, rate))
        score += _value(trees[-1], xa)
    made = Model(trees, *_curve(sum(_value(t, x[rest]) for t in trees), y[rest]), 0.5)
    held = made.scores(x[rest])
    fine = [t for t in np.unique(held) if t >= 0.5 and y[rest][held >= t].mean() >= precision]
    made.threshold = float(min(fine, default=np.inf)) - 1e-9
    return made


EXAMPLES = 4000


def examples(n: int = EXAMPLES, seed: int = 8) -> list[tuple[str, str, int]]:
    """Labelled texts with one candidate each: (kind, text, 1 if personal)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    mixed = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k))
    us = lambda: r.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}", "{} {} {}"]).format(r.choice("23456789") + d(2), r.choice("23456789") + d(2), d(4))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    name = lambda: word().capitalize()

    def iban() -> str:
        country, rest = r.choice(["DE", "FR", "GB", "ES", "NL", "IT"]), r.choice([d(18), r.choice(["NWBK", "ABNA"]) + d(14), d(20), upper(1) + d(22)])
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        made = f"{country}{check:02d}{rest}"
        return r.choice([made, " ".join(made[i : i + 4] for i in range(0, len(made), 4))])

    def ipv6() -> str:
        groups = [hexes(r.randint(1, 4)) for _ in range(8)]
        return r.choice([":".join(groups), ":".join(groups[: r.randint(1, 4)]) + "::" + ":".join(groups[: r.randint(1, 3)]), "fe80::" + ":".join(groups[:4])])

    street = lambda: r.choice(["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Court", "Place"])
    personal = {
        "key": [
            lambda: r.choice(["sk_live_", "sk_test_", "rk_live_", "ghp_", "gho_", "xoxb-", "glpat-", "AIza", "npm_", "hf_"]) + mixed(r.randint(20, 36)),
            lambda: "AKIA" + upper(16), lambda: r.choice(["Bearer ", "the key is ", "auth token "]) + mixed(r.randint(20, 60)),
            lambda: f"eyJ{mixed(20)}.eyJ{mixed(r.randint(20, 60))}.{mixed(r.randint(20, 43))}",
            lambda: r.choice(["key ", "token is ", "credentials "]) + hexes(r.choice([32, 40, 64])), lambda: mixed(r.randint(32, 48)),
        ],
        "iban": [lambda: r.choice(["iban ", "", "account "]) + iban()],
        "ipv6": [lambda: r.choice(["", "from ", "host "]) + ipv6()],
        "address": [lambda: f"{r.randint(1, 9999)} {name()} {street()}", lambda: f"{r.randint(1, 9999)} {name()} {name()} {street()}", lambda: f"{name()}{r.choice(['straße', 'weg', 'platz'])} {r.randint(1, 200)}"],
        "name": [lambda: f"{r.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Herr', 'Frau'])} {name()}{r.choice(['', ' ' + name()])}", lambda: f"{r.choice(['my name is', 'Name:'])} {name()} {name()}"],
        "number": [
            lambda: r.choice(["phone ", "call me at ", "tel: ", "mobile no. ", "fax "]) + r.choice([us(), "0" + d(9), d(3) + " " + d(7)]),
            lambda: us(),
            lambda: r.choice(["ssn ", "", "social security number "]) + f"{d(3)}-{d(2)}-{d(4)}",
            lambda: r.choice(["passport no ", "account ", "tax id ", "insurance no. "]) + d(r.randint(8, 12)),
        ],
        "contact": [
            lambda: f"{word()} {r.choice(['at', '(at)', '[at]'])} {word()} {r.choice(['dot', '(dot)', '[dot]'])} {r.choice(['com', 'org', 'net'])}",
            lambda: f"{word()}.{word()}{r.choice(['(at)', '[at]'])}{word()}.{r.choice(['com', 'org', 'de'])}",
        ],
        "secret": [
            lambda: r.choice(["password=", "pwd: ", 'token = "', "api_key=", "secret: "]) + mixed(r.randint(8, 40)),
            lambda: r.choice(['token = "', "password="]) + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40))),
            lambda: r.choice(["password: ", "passwd="]) + word() + d(2) + r.choice("!#%&*"),
        ],
    }
    harmless = {
        "key": [
            lambda: f"{word()}-{word()}-{d(2)}-{word()}{word()}", lambda: f"{word()}{word()}{word()}{word()}{d(1)}", lambda: f"{word()}_{word()}_{word()}_{d(4)}",
            lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}", lambda: f"{word()}{word()}{word()}-v{d(1)}-{word()}", lambda: f"{d(14)}th", lambda: f"{word()}{word()}-{word()}{word()}-{d(2)}.{word()}{word()}",
            lambda: f"{r.choice(['sha', 'commit', 'checksum', 'hash'])} {hexes(r.choice([16, 32, 40, 64]))}", lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        ],
        "iban": [lambda: r.choice(["", "part ", "model "]) + r.choice(["AB", "XK", "MK", "DE"]) + d(2) + "".join(r.choice([" ", ""]) + upper(4) for _ in range(r.randint(2, 5)))],
        "ipv6": [lambda: f"1{d(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", lambda: f"{word()} ::", lambda: f"{d(1)}:{d(1)}:{d(1)}"],
        "address": [lambda: f"{r.randint(1, 9999)} {name()}", lambda: f"{r.randint(1, 9999)} {name()} {name()}", lambda: f"{r.randint(1, 31)} {r.choice(['January', 'March', 'May', 'October'])}", lambda: f"{r.randint(1, 99)} {name()} {name()} {name()} {name()}"],
        "name": [lambda: f"{r.choice(['I am', 'Contact', 'contact', 'Dear', 'dear'])} {name()}", lambda: f"Contact {r.choice(['Us', 'Sales', 'Support', 'The Team'])}"],
        "number": [
            lambda: r.choice(["order ", "isbn ", "item ", "version ", "serial ", "page "]) + d(r.randint(7, 13)),
            lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}.{d(2)}",
            lambda: d(r.randint(7, 24)) + r.choice([" items", " people", " units", "", " " + word()]),
            lambda: " ".join(d(r.randint(1, 3)) for _ in range(r.randint(7, 12))),
            lambda: ".".join(d(r.randint(1, 4)) for _ in range(r.randint(4, 8))),
            lambda: d(1) * r.randint(7, 30),
        ],
        "contact": [lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at www.{word()}.com", lambda: f"{word()} at {word()}.{word()}.{word()}"],
        "secret": [
            lambda: r.choice(["password: ", "token = ", "secret: ", "token: "]) + r.choice(["required", "none", "value", word() + word(), "null", "hidden"]),
            lambda: r.choice(["password=", "secret: "]) + "*" * r.randint(4, 12),
        ],
    }
    out = []
    for i in range(n):
        kind, label = ADDED[i % len(ADDED)], (i // len(ADDED)) % 2
        body = r.choice((personal if label else harmless)[kind])()
        out.append((kind, f"{word()} {word()} {body} {word()}.", label))
    return out


_models: dict[int, dict[str, Model]] = {}


def train(spark: SparkSession, n: int = EXAMPLES) -> dict[str, Model]:
    """Models by kind, fitted to ``n`` generated examples once a process."""
    if n in _models:
        return _models[n]
    rows = [(i, *x) for i, x in enumerate(examples(n))]
    df = spark.createDataFrame(rows, "i int, kind string, text string, label int").coalesce(1)
    text, found = F.col("text"), candidates(F.col("text"))
    at = F.coalesce(*[F.when(F.col("kind") == k, found[k]) for k in ADDED])
    got = df.withColumn("s", F.get(at, 0)).where("s is not null").select("kind", "label", features(text, F.col("s")).alias("x")).collect()
    _models[n] = {
        k: fit(np.array([r["x"] for r in got if r["kind"] == k]), np.array([r["label"] for r in got if r["kind"] == k], float)) for k in ADDED
    }
    return _models[n]


# --- the operator


def _tagged(found: Column, kind: str) -> Column:
    number = [*BASE, *ADDED].index(kind)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _number_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def _joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text", prefix: str = "__pii_") -> DataFrame:
    """``docs`` with two arrays of spans, ``<prefix>base`` and ``<prefix>all``: ``start``, ``number``, ``stop``, ``kind``."""
    models = train(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[_tagged(c, k) for k, c in base_spans(text).items()]))
    with_base = docs.withColumn(f"{prefix}base", base)
    known = F.col(f"{prefix}base")

    # The proposed spans of all kinds in one array, so that the features are written once.
    tagged = lambda k: F.transform(
        F.col(f"{prefix}{k}"),
        lambda s: F.struct(s["start"].alias("start"), F.lit([*BASE, *ADDED].index(k)).alias("number"), s["stop"].alias("stop"), F.lit(k).alias("kind"), s["value"].alias("value")),
    )
    apart = lambda s: ~F.exists(known, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    with_x = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "number", "stop", "kind")], features(text, s).alias("x"))
    judged = with_base.withColumns({f"{prefix}{k}": c for k, c in candidates(text).items()})
    judged = judged.withColumn(f"{prefix}found", F.concat(*[tagged(k) for k in ADDED])).drop(*[f"{prefix}{k}" for k in ADDED])
    judged = judged.withColumn(f"{prefix}found", F.when(F.size(f"{prefix}found") > 0, F.transform(F.filter(f"{prefix}found", apart), with_x)))
    tests = " ".join(f"WHEN '{k}' THEN {models[k].sql('s.x')} >= {models[k].threshold!r}D" for k in ADDED if np.isfinite(models[k].threshold))
    chosen = F.expr(f"transform(filter({prefix}found, s -> CASE s.kind {tests} ELSE false END), s -> struct(s.start, s.number, s.stop, s.kind))")
    both = F.when(F.size(f"{prefix}found") > 0, F.array_sort(F.concat(known, chosen))).otherwise(known)
    return judged.withColumn(f"{prefix}all", both).drop(f"{prefix}found")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``.

    Spans are written kind:start:end, by start and then kind (base kinds first), joined by commas; the digest is of the
    base spans. Null texts are empty and have none; several kinds may start at one place. Repeated rows are each looked
    at; an empty table gives no rows; other columns are not looked at.
    """
    rows = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.col("__pii_base")
    return rows.select(
        "doc_id",
        *[_number_of(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("__pii_all")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null. All columns are kept.
    """
    found = find(docs, text_col)
    text = F.col(text_col)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(
        F.col("__pii_all"),
        empty,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.char_length(text))),
    )
    return found.withColumn(text_col, F.when(F.size("__pii_all") > 0, built).otherwise(text)).drop("__pii_base", "__pii_all")
