"""Personal data by weak supervision: spans of e-mail addresses, IP addresses, card numbers and phone numbers.

Base spans are those of four fixed patterns (BASE) with their checks; they always stay. Wider patterns (WIDE) name further
candidates: addresses whose @ and dots are spelled out or spaced, numbers without their plus or with other separators,
six-part addresses. On every candidate, base ones too, labelers vote for, against or not at all: patterns and checksums,
gazetteers (ends of domains, card issuers, dialling codes, address ranges that name no machine) and the words around
it. A vote has no labels to be judged by, so expectation-maximisation estimates for each kind how often each labeler
votes how on true and on false candidates; all it needs is the number of candidates of each pattern of votes, which
Spark counts over the whole corpus (at most 3 ** labelers patterns a kind, however large the corpus). A logistic
regression per kind then learns the posteriors from the span's shape and the hashed words around it, on at most `sample`
candidates a kind, and decides on every candidate: those it is sure of (`sure`) that overlap no base span and no better
candidate are added. Texts are read once; what is decided later is decided on the table of candidates.

Each pattern takes time in proportion to the text, also in runs of one kind of characters however long. Null or
empty text: no spans. Offsets are code points, ends exclusive. Repeated rows: as many output rows. A kind that has no
candidate, or on which the votes never differ, adds nothing. Other columns take no part. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held, materialize

KINDS = ("email", "ip", "card", "phone")
#: What may stand before an @.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit before a run can't begin another match of it, so looking behind changes nothing but the time.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\]|\{at\}|\bat\b)\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?[A-Za-z0-9-]{1,63}+){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\s?[.\[\]()]{1,3}\s?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20./_-]{1,3}[0-9]{3,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])"),
}
#: Words that stand beside personal data, ends of domains, first digits of card issuers, dialling codes.
CONTEXT = {
    "email": "mail e-mail email contact write reach address courriel adresse correo contacto kontakt schreib an from to cc reply",
    "ip": "ip host server address client login from gateway dns ping addr adresse direccion serveur servidor",
    "card": "card visa mastercard amex credit debit payment pay account carte tarjeta karte kreditkarte pan cvv expires",
    "phone": "phone tel telephone call mobile cell fax dial whatsapp sms telefon telefono téléphone teléfono móvil handy rufen appeler llamar",
}
AGAINST = {
    "email": "meet look arrive stay dot",
    "ip": "version release chapter section v ver kapitel chapitre capitulo",
    "card": "isbn order invoice serial id hash token total number nr no numéro pedido bestellung",
    "phone": "isbn version total price from between page pages vol year years born",
}
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io ai co me tv app dev eu uk de fr es it nl be ch at pt pl se no dk fi ie us ca mx br ar cl au nz jp cn in ru tr za".split())
ISSUERS = ("34", "37", "300", "301", "302", "303", "304", "305", "36", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "35") + tuple(str(n) for n in range(2221, 2721))
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "380", "420", "421")
BUCKETS = 1 << 12

CANDIDATE = "kind tinyint, start long, end long, base boolean, votes string, features array<int>"
FOUND = f"doc_id long, base array<struct<kind:tinyint,start:long,end:long>>, candidates array<struct<{', '.join(x.replace(' ', ':', 1) for x in CANDIDATE.split(', '))}>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of LOCAL+ and AT: what stands before an @ is a whole run, or what a match has left of it."""
    free = 0
    for m in AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), in that order."""
    out = [(0, a, b) for a, b in base_emails(text)]
    for number, kind in enumerate(KINDS):
        for m in BASE[kind].finditer(text) if kind in BASE else ():
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            elif m.end() - m.start() < (16 if kind == "card" else 8):
                continue
            else:
                digits = digits_of(m[0])
                good = 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
            if good:
                out.append((number, m.start(), m.end()))
    return out


def labelers(kind: str, span: str, before: list[str], after: list[str], base: bool) -> list[int]:
    """Votes on a candidate: 1 for, -1 against, 0 none. Patterns and checks first, then gazetteers, then context."""
    digits, near = digits_of(span), before[-3:] + after[:2]
    words = [w.strip(".,;:()[]=\"'").lower() for w in near]
    context = [1 if any(w in CONTEXT_SETS[kind] for w in words) else 0, -1 if any(w in AGAINST_SETS[kind] for w in words) or any("=" in w for w in near) else 0]
    if kind == "email":
        end = re.split(r"[^A-Za-z0-9-]", span)[-1].lower()
        spelled = re.search(r"[(\[{]\s?(?:at|dot)", span, re.I)
        checks = [1 if base else 0, 1 if "@" in span or spelled else -1, -1 if re.search(r"\sat\s", span) and " dot " not in span.lower() else 0]
        gazetteer = [1 if end in DOMAIN_ENDS else -1]
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        four = ":" not in span
        checks = [1 if base else 0, -1 if four and any(int(p) > 255 for p in parts) else 1 if four else 0, 1 if not four and span.count(":") >= 3 else 0, -1 if four and max(map(len, parts)) < 2 else 0]
        gazetteer = [-1 if four and int(parts[0]) in (0, 255) else 0]
    elif kind == "card":
        groups = [len(g) for g in re.findall(r"[0-9]+", span)]
        checks = [1 if base else 0, 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1, 1 if groups in ([4, 4, 4, 4], [4, 6, 5]) else -1 if len(groups) > 1 else 0, -1 if len(set(digits)) < 4 else 0]
        gazetteer = [1 if digits.startswith(ISSUERS) else -1]
    else:
        checks = [1 if base else 0, 1 if span.startswith(("+", "00")) else 0, 1 if 9 <= len(digits) <= 13 else -1, 1 if "(" in span else 0, -1 if re.fullmatch(r"[0-9.]+", span) or re.search(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.]", span) else 0]
        gazetteer = [1 if span.startswith("+") and digits.startswith(DIALLING) or span.startswith("00") and digits[2:].startswith(DIALLING) else 0]
    return checks + gazetteer + context


CONTEXT_SETS = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
AGAINST_SETS = {k: frozenset(v.split()) for k, v in AGAINST.items()}


def features(kind: str, span: str, before: list[str], after: list[str], votes: list[int]) -> list[int]:
    """Hashed features of a candidate: its shape, its parts, the words around it, the votes of checks and gazetteers."""
    shape = re.sub(r"[^0-9Aa]", lambda m: m[0], re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", span))))
    short = re.sub(r"(.)\1+", r"\1", shape)
    names = [f"s{short[:24]}", f"l{min(len(span), 40) // 2}", f"d{min(len(digits_of(span)), 24)}", f"e{span[-3:].lower()}" if kind == "email" else f"h{span[:2]}"]
    names += [f"g{short[i : i + 3]}" for i in range(min(len(short) - 2, 24))]
    names += [f"b{w.lower()[:16]}" for w in before[-3:]] + [f"a{w.lower()[:16]}" for w in after[:2]]
    names += [f"v{i}{v}" for i, v in enumerate(votes)]
    return sorted({zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % BUCKETS for n in names})


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans and the wider patterns' spans that touch no base span, with votes and features."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.empty(0, np.int64)
    for number, kind in enumerate(KINDS):
        own = [(a, b, True) for k, a, b in base if k == number]
        if kind != "email" or "@" in text or "at" in text or "AT" in text or "At" in text:
            for m in WIDE[kind].finditer(text):
                i = int(np.searchsorted(starts, m.end()))  # base spans before i begin before the end of this one
                if not i or ends[i - 1] <= m.start():
                    own.append((m.start(), m.end(), False))
        for a, b, is_base in own:
            before, after = text[max(0, a - 64) : a].split(), text[b : b + 48].split()
            votes = labelers(kind, text[a:b], before, after, is_base)
            out.append({"kind": number, "start": a, "end": b, "base": is_base, "votes": "".join("-0+"[v + 1] for v in votes), "features": features(kind, text[a:b], before, after, votes)})
    return out


def find(docs: DataFrame) -> DataFrame:
    """FOUND: a row a document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base = base_spans(text) if text else []
                    rows.append({"doc_id": doc, "base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "candidates": candidates(text, base) if text else []})
                schema = schema or _arrow()
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, FOUND)


def _arrow() -> pa.Schema:
    span = [("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64())]
    full = [*span, ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
    return pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("candidates", pa.list_(pa.struct(full)))])


def reliabilities(patterns: list[str], counts: np.ndarray, steps: int = 100, prior: float = 0.5) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of true candidates; how often (truth, labeler, vote) is seen; the posterior of each pattern of votes.

    Labelers are taken as independent given the truth. They start as better than chance, which tells the true class from
    the false one; a count of one for and of one against each vote keeps rare ones from certainty.
    """
    votes = np.array([["-0+".index(c) for c in p] for p in patterns])
    weight = np.asarray(counts, float)
    chance = np.tile(np.array([[[0.5, 0.35, 0.15]], [[0.15, 0.35, 0.5]]]), (1, votes.shape[1], 1))
    share = prior
    hot = votes[:, :, None] == np.arange(3)
    for _ in range(steps):
        like = [np.log(c) + np.log(np.take_along_axis(chance[y][None], votes[:, :, None], axis=2)[..., 0]).sum(axis=1) for y, c in ((0, 1 - share), (1, share))]
        true = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        for y, part in ((0, weight * (1 - true)), (1, weight * true)):
            seen = (part[:, None, None] * hot).sum(axis=0) + chance[y].mean(axis=0) + 0.5
            chance[y] = seen / seen.sum(axis=1, keepdims=True)
        share = float(np.clip((weight @ true + 1) / (weight.sum() + 2), 1e-4, 1 - 1e-4))
    return share, chance, true


@dataclass
class Classifier:
    bias: np.ndarray  # of each kind
    weight: np.ndarray  # kind x bucket

    def sure(self, kind: int, found: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias[kind] + self.weight[kind][found].sum(), -60, 60))))


def logistic(rows: list[list[int]], goal: np.ndarray, weights: np.ndarray, steps: int = 150, penalty: float = 0.02) -> tuple[float, np.ndarray]:
    """Weighted logistic regression on soft labels, by gradient steps of the length that its curvature allows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([x for r in rows for x in r], np.int64)
    w, bias, weights = np.zeros(BUCKETS), 0.0, weights / weights.sum()
    widest = max(map(len, rows), default=0) + 1
    rate = 4.0 / (widest + 4 * penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[column], len(rows)), -60, 60)))
        error = (p - goal) * weights
        w -= rate * (np.bincount(column, error[row], BUCKETS) + penalty / len(rows) * w)
        bias -= rate * error.sum()
    return bias, w


def fit(found: DataFrame, sample: int = 3000) -> Classifier:
    """Reliabilities from the counts of all candidates, then a classifier a kind from at most `sample` candidates."""
    each = found.select("doc_id", F.inline("candidates"))
    counted = sorted(map(tuple, each.groupBy("kind", "votes").count().collect()))  # 3 ** labelers a kind at most
    out = Classifier(np.full(len(KINDS), -60.0), np.zeros((len(KINDS), BUCKETS)))
    for kind in range(len(KINDS)):
        patterns = [(v, n) for k, v, n in counted if k == kind]
        if len(patterns) < 2:
            continue
        _, _, true = reliabilities([v for v, _ in patterns], np.array([n for _, n in patterns]))
        posterior = dict(zip((v for v, _ in patterns), true.tolist(), strict=True))
        order = F.xxhash64(F.lit(3), "doc_id", "start", "end"), "doc_id", "start", "end", "votes"
        rows = each.filter(F.col("kind") == kind).orderBy(*order).limit(sample).select("votes", "features").collect()
        goal = np.array([posterior[r["votes"]] for r in rows])
        out.bias[kind], out.weight[kind] = logistic([r["features"] for r in rows], goal, np.ones(len(rows)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def decided(base: list[tuple[int, int, int]], candidates: list[dict], model: Classifier, sure: float) -> list[tuple[int, int, int]]:
    """base and the candidates that are sure enough, the surest of overlapping ones."""
    scored = sorted(((-model.sure(c["kind"], c["features"]), c["kind"], c["start"], c["end"]) for c in candidates if not c["base"]))
    starts, ends, out = [], [], list(base)  # of what is added, in order
    for score, kind, a, b in scored:
        if -score < sure:
            break
        i = bisect_left(starts, a)
        if (not i or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b))
    return out


def pii_report(docs: DataFrame, sample: int = 3000, sure: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans; spans: those and the added ones."""
    found = materialize(find(docs), "pii-found")
    model = fit(found, sample)
    mark = f"pii {zlib.crc32(model.weight.tobytes())} {model.bias.tolist()} {sure}"
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(mark, lambda: model)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = [(s["kind"], s["start"], s["end"]) for s in base]
                for number, of in enumerate(counts):
                    of.append(sum(k == number for k, _, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(decided(base, more, own, sure)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return found.mapInArrow(decide, schema)
