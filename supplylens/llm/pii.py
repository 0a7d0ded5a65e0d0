"""Personal data by weak supervision.

Base spans (e-mail, IP address, card, phone) come from four fixed formats and always stay. Looser patterns propose further
candidates of more kinds; six labelers (regular expressions, gazetteers, context) each vote for, against or abstain. Expectation-maximisation over the
counts of vote patterns estimates every labeler's reliability without labels; the posteriors train
a logistic span classifier, whose decisions add spans where no base span lies.

Vote patterns are counted over all documents, map-side first; what reaches the driver is one row for each
pattern that occurs, of a finite set.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, in the order in which spans with one start are listed after the base kinds.
ADDED_KINDS = ("email_spelled", "phone_local", "ssn", "iban", "name", "secret", "street")
KINDS = BASE_KINDS + ADDED_KINDS
KIND_AT = {k: i for i, k in enumerate(KINDS)}

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each ``@`` in turn: the longest local part left of it and the longest domain right of it.

    The result is that of scanning for the format, in linear time whatever the text.
    """
    out, end, at = [], 0, text.find("@")
    low = 0
    while at >= 0:
        left = text[max(end, low) : at]
        start = at - (len(left) - len(left.rstrip(LOCAL_CHARS)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        low = at + 1
        at = text.find("@", max(low, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Groups of four parts in each run of digits and dots; groups with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) < 3:
            continue
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    found += [(s, 1, e) for s, e in ips(text)]
    found += [(s, 2, e) for s, e in cards(text)]
    if "+" in text:
        found += [(s, 3, e) for s, e in phones(text)]
    return sorted(found)


# Patterns of candidates, by kind. Each begins where its run of characters begins, so that a search is linear whatever the text.
CANDIDATES = {
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]+)+"),
    "phone_local": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?"),
    "secret": re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api_key|apikey)\s?[=:]\s?[^\s,;]{4,}"),
    "street": re.compile(r"(?<![0-9])[0-9]+\x20[A-Z][a-z]+\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq)(?![a-z])"),
}
#: A text without the group's strings, or a match of its pattern, has no candidate of the kind, so most texts are searched for few kinds.
NEEDS = {
    "email_spelled": re.compile(r"at\s?[\])]"),
    "iban": None,
    "phone_local": None,
    "ssn": None,
    "name": ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey"),
    "street": ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Square", "Sq"),
}
# Gazetteers. Lists of one's own, of any length, are arguments of fit() and find().
GIVEN_NAMES = frozenset("""
adam alan albert alejandro alex alexander alice amy ana andrea andrew angela anita ann anna anne anthony antonio arthur barbara ben benjamin bernard brian bruno carl carla carlos carmen
caroline catherine charles charlotte chris christian christina christine christopher claire claudia clara daniel david deborah diana diego dieter donald dorothy edward elena elisabeth
elizabeth emily emma eric erik ernesto eva felix fernando francisco frank franz gabriel george gerhard giulia gloria greta hannah hans harry heinz helen helena henri henry hugo ian ines
ingrid irene isabel ivan jack jacques james jan jane janet jason javier jean jennifer jessica joan johann john jonathan jorge jose joseph juan julia julie karen karin karl kate katharina
kevin klaus larry laura lena leo linda lisa louis louise lucas lucia luis luke manuel marc margaret maria marie mario marion mark marta martin mary matthew michael michel miguel monica
nancy nicolas nicole olivia oscar otto pablo pascal patricia patrick paul paula pedro peter philip pierre rachel rafael ralf raul rebecca richard robert roberto rosa ruth samuel sandra
sara sarah sebastian sergio silvia simon sofia sophie stefan stephen steven susan sylvie teresa thomas tobias ursula valerie vera victor walter werner william wolfgang yves
""".split())
PROVIDERS = frozenset("aol.com bluewin.ch fastmail.com free.fr gmail.com gmx.de gmx.net googlemail.com hotmail.com hotmail.fr icloud.com laposte.net libero.it live.com mail.com mail.ru me.com msn.com orange.fr outlook.com outlook.de proton.me protonmail.com qq.com sfr.fr t-online.de terra.es web.de yahoo.com yahoo.de yahoo.es yahoo.fr yandex.ru zoho.com".split())
IBAN_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split())
CUES = {
    "email": "mail e-mail email contact write address correo courriel", "ip": "ip address host server from login adresse", "card": "card visa credit mastercard payment karte carte tarjeta",
    "phone": "call phone tel telephone mobile cell fax number ring telefon", "email_spelled": "mail email contact write", "phone_local": "call phone tel telephone mobile cell fax number ring telefon",
    "ssn": "ssn social security number", "iban": "iban account bank konto", "name": "dear by from contact signed", "secret": "login user account", "street": "address at live lives street",
}
CUE_WORDS = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version release build section page chapter isbn rfc example sample test dummy fake".split())


@dataclass(frozen=True)
class Gazetteers:
    """What the gazetteer labeler looks spans up in: given names and mail domains in lower case, and country codes of bank accounts."""

    names: frozenset[str] = GIVEN_NAMES
    domains: frozenset[str] = PROVIDERS
    countries: frozenset[str] = IBAN_COUNTRIES


LABELERS = ("format", "checksum", "gazetteer", "cue", "counter_cue", "boundary")
WORD = re.compile(r"[A-Za-z-]+")


def secrets(text: str, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Secrets to their end, without the base spans in them: what lies before the first, if it is a secret itself, and what lies after each."""
    b = 0
    for m in CANDIDATES["secret"].finditer(text):
        while b < len(base) and base[b][1] <= m.start():
            b += 1
        i, at, parts = b, m.start(), []
        while i < len(base) and base[i][0] < m.end():
            parts.append((at, base[i][0]))
            at = max(at, base[i][1])
            i += 1
        parts.append((at, m.end()))
        if CANDIDATES["secret"].fullmatch(text, *parts[0]):
            yield parts[0]
            yield from (p for p in parts[1:] if p[1] - p[0] >= 4)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser matches that touch no base span. Those of one kind don't overlap; those of several may, until :func:`settle` has chosen."""
    found = []
    taken = sorted((s, e) for s, _, e in base)
    digit = any(map(text.__contains__, "0123456789"))
    for kind, pattern in CANDIDATES.items():
        needs = NEEDS[kind]
        if digit if needs is None else needs.search(text) if isinstance(needs, re.Pattern) else any(n in text for n in needs):
            found += [(s, KIND_AT[kind], e) for s, e in (secrets(text, taken) if kind == "secret" else (m.span() for m in pattern.finditer(text)))]
    if not found or not taken:
        return sorted(found)
    starts = [s for s, _ in taken]
    # Base spans of several kinds can overlap, so the furthest end so far counts.
    ends = list(accumulate((e for _, e in taken), max))
    free = lambda s, e: (i := bisect_left(starts, e)) == 0 or ends[i - 1] <= s
    return [c for c in sorted(found) if free(c[0], c[2])]


def settle(scored: list[tuple[float, tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """Of accepted candidates that overlap the ones with the better score stay; ties go to the earlier start, then the earlier kind."""
    if len(scored) < 2:
        return [c for _, c in scored]
    out: list[tuple[int, int, int]] = []
    for _, (s, k, e) in sorted(scored, key=lambda x: (-x[0], x[1])):
        i = bisect_left(out, (s, k, e))
        if (i == 0 or out[i - 1][2] <= s) and (i == len(out) or out[i][0] >= e):
            out.insert(i, (s, k, e))
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, kind: int, end: int, known: Gazetteers = Gazetteers()) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains: one entry for each of ``LABELERS``."""
    name, span = KINDS[kind], text[start:end]
    digits = [c for c in span if c in "0123456789"]
    before = WORD.findall(text[max(0, start - 48) : start].lower())[-4:]
    form = 0
    if name in ("phone", "phone_local"):
        form = 1 if len(digits) >= 10 else -1
    elif name == "ssn":
        form = -1 if span.startswith(("000", "666", "9")) or span[4:6] == "00" else 1
    elif name == "iban":
        form = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
    elif name == "secret":
        value = re.split(r"[=:]\s?", span, maxsplit=1)[-1]
        form = 1 if digits and len(value) >= 8 else (-1 if value.isalpha() else 0)
    elif name in ("email", "email_spelled", "ip", "card"):
        form = 1
    check = 0
    if name == "card":
        check = 1 if luhn("".join(digits)) else -1
    elif name == "iban":
        check = 1 if _iban_ok(span) else -1
    elif digits and len(set(digits)) == 1:
        check = -1
    gazetteer = 0
    if name == "name":
        gazetteer = 1 if any(w in known.names for w in WORD.findall(span.lower())) else 0
    elif name.startswith("email"):
        domain = re.sub(r"\s?[\[(]\s?dot\s?[\])]\s?", ".", re.split(r"@|[\[(]\s?at\s?[\])]\s?", span.lower())[-1]).split(".")
        gazetteer = 1 if any(".".join(domain[i:]) in known.domains for i in range(len(domain))) else 0
    elif name == "iban":
        gazetteer = 1 if span[:2] in known.countries else -1
    elif name == "secret":
        gazetteer = 1
    cue = 1 if CUE_WORDS[name].intersection(before) else 0
    counter = -1 if AGAINST.intersection(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    boundary = -1 if (left.isalnum() or right.isalnum() or left in "/=_#" and left) else 1
    return form, check, gazetteer, cue, counter, boundary


def _shape(text: str, start: int, kind: int, end: int, known: Gazetteers = Gazetteers()) -> str:
    """Everything the model sees of a span: kind, votes, a bucket of its length and one of its share of digits."""
    span = text[start:end]
    share = sum(c.isdigit() for c in span) / len(span)
    return ",".join(map(str, (kind, *votes(text, start, kind, end, known), min(7, (end - start).bit_length()), int(share * 4))))


@dataclass
class SpanModel:
    prior: np.ndarray  # by kind
    reliability: dict[str, dict[str, tuple[float, float]]]  # kind, labeler: P(for | span), P(against | no span), of votes cast
    weights: np.ndarray

    def score(self, shape: str) -> float:
        return round(float(design([shape])[0] @ self.weights), 9)

    def accepts(self, shape: str) -> bool:
        return self.score(shape) > 0


def design(shapes: list[str]) -> np.ndarray:
    """One row for each shape: intercept, kind, votes, length and digit buckets."""
    x = np.zeros((len(shapes), 1 + len(KINDS) + len(LABELERS) + 8 + 5))
    for i, s in enumerate(shapes):
        kind, *v, length, digits = map(int, s.split(","))
        x[i, 0] = 1
        x[i, 1 + kind] = 1
        at = 1 + len(KINDS)
        x[i, at : at + len(LABELERS)] = v
        x[i, at + len(LABELERS) + length] = 1
        x[i, at + len(LABELERS) + 8 + digits] = 1
    return x


def estimate(counts: dict[str, int], rounds: int = 30, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over shapes: posteriors, prior by kind, and P(vote | class) as [class, kind, labeler, against/abstain/for].

    The model starts from the majority vote; abstaining is an outcome like the others. Each labeler has a reliability for every kind, drawn towards its
    reliability over all kinds with the weight of ``strength`` observations, so that rare kinds borrow from the others.
    """
    shapes = list(counts)
    n = np.array([counts[s] for s in shapes], dtype=float)
    rows = np.array([list(map(int, s.split(","))) for s in shapes], dtype=int).reshape(len(shapes), -1)
    kind, v = rows[:, 0], rows[:, 1 : 1 + len(LABELERS)] + 1
    post = 1 / (1 + np.exp(-1.0 * (v - 1).sum(axis=1)))
    prior, theta = np.full(len(KINDS), 0.5), np.zeros((2, len(KINDS), len(LABELERS), 3))
    for _ in range(rounds):
        prior = (np.bincount(kind, n * post, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(len(LABELERS)):
                own = np.bincount(kind * 3 + v[:, j], w, 3 * len(KINDS)).reshape(len(KINDS), 3)
                pooled = (own.sum(axis=0) + 1) / (own.sum() + 3)
                theta[c, :, j] = (own + strength * pooled) / (own.sum(axis=1, keepdims=True) + strength)
        logit = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(len(LABELERS)):
            logit = logit + np.log(theta[1, kind, j, v[:, j]] / theta[0, kind, j, v[:, j]])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, prior, theta


def train(counts: dict[str, int]) -> SpanModel:
    """Reliabilities by EM, then a logistic regression on the posteriors; log counts keep one shape from outweighing all others."""
    width = design([]).shape[1]
    if not counts:
        return SpanModel(np.full(len(KINDS), 0.5), {}, np.zeros(width))
    post, prior, theta = estimate(counts)
    shapes = list(counts)
    x, w = design(shapes), np.log1p(np.array([counts[s] for s in shapes], dtype=float))
    beta = np.zeros(width)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (post - p)) - 0.5 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    cast = lambda t, i: float(t[i] / max(t[0] + t[2], 1e-12))
    reliability = {kind: {name: (cast(theta[1, k, j], 2), cast(theta[0, k, j], 0)) for j, name in enumerate(LABELERS)} for k, kind in enumerate(KINDS)}
    return SpanModel(prior, reliability, np.round(beta, 9))


def fit(docs: DataFrame, known: Gazetteers = Gazetteers()) -> SpanModel:
    """Count the shapes of all spans, base ones and candidates, over all of ``docs`` and train on the counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                total.update(_shape(text, s, k, e, known) for s, k, e in base)
                total.update(_shape(text, s, k, e, known) for s, k, e in candidates(text, base))
        yield pd.DataFrame(sorted(total.items()), columns=["shape", "n"])

    # kinds x votes x buckets: a finite set, of which a few hundred occur.
    rows = docs.select("text").mapInPandas(count, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect()
    return train({r[0]: r[1] for r in sorted(rows)})


def find(docs: DataFrame, model: SpanModel, known: Gazetteers = Gazetteers()) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, base), in order of start, then kind.

    Null and empty texts have no spans; texts of any length are searched whole; repeated rows give equal rows; an empty
    table gives none. Only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        seen: dict[str, float] = {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                base = base_spans(text)
                spans = [(s, k, e, True) for s, k, e in base]
                good = []
                for s, k, e in candidates(text, base):
                    shape = _shape(text, s, k, e, known)
                    if shape not in seen:
                        seen[shape] = m.score(shape)
                    if seen[shape] > 0:
                        good.append((seen[shape], (s, k, e)))
                spans += [(*c, False) for c in settle(good)]
                out.append((doc, [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(spans)]))
            frame = pd.DataFrame(out, columns=["doc_id", "spans"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(work, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_spans (all spans), base_sha256, spans."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
