"""Personal data: exact base patterns, and further spans by weak supervision (votes, expectation-maximisation, a classifier)."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import forget, let_go, saved

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email_spelled", "phone_local", "ssn", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails does so from any of its digits, so only its first need be tried.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "phone_local": re.compile(r"(?<![0-9+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
AT = re.compile(r" ?(?:\[at\]|\(at\)) ?")
SPELLED = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]+)+")
#: A secret is a run of these characters with letters and digits, or what is assigned to a word that names one.
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
DIGITS = re.compile(r"[0-9]+")
ASSIGN = re.compile(r"[:=]")
NAMED = re.compile(r"(?:password|passwd|pwd|passwort|contraseña|secret|token|api[_-]?key)['\"]?\s{0,4}$", re.I)
VALUE = re.compile(r"\s{0,4}['\"]?([^\s'\"]{8,})")
# Gazetteers: endings of mail domains, first digits of card issuers, beginnings of keys that services hand out, fillers.
ENDINGS = frozenset("com org net edu gov io co info biz de fr es uk us eu".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "eyJ", "AIza")
FILLERS = ("example", "changeme", "xxxx", "placeholder", "0123456789", "deadbeef")
CUES = {
    "email": "mail contact write correo courriel",
    "ip": "ip address host server login from",
    "card": "card credit visa mastercard amex payment tarjeta karte carte",
    "phone": "phone call tel mobile fax contact telefon teléfono téléphone",
    "ssn": "ssn social security",
    "secret": "token secret password passwd pwd passwort contraseña clave key apikey api_key bearer credential credentials",
}
AGAINST = "version license isbn order build rfc section issn doi sha commit revision checksum".split()
CUE = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")\b", re.I) for k, v in CUES.items()}
NOT = re.compile(r"\b(?:" + "|".join(AGAINST) + r")\b", re.I)
LABELERS = ("shape", "gazetteer", "cue words", "counter words", "surroundings", "variety")
#: What is believed of P(vote | personal) beforehand, by its weight beside what is seen; mirrored if not personal.
BELIEF = 0.1 * np.array([0.1, 0.3, 0.6])
#: Slots of the span classifier's hashed features.
SLOTS = 1 << 14


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each @ outwards so that long runs are walked once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m, start = DOMAIN.match(text, at + 1), at
        if m:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes the kind's test) in the order of KINDS, then start."""
    out = [("email", a, b, True) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        out.append(("ip", m.start(), m.end(), all(small(p) for p in m[0].split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if len(digits) >= 13:
                out.append(("card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15))
    return out


def spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the signs as words in brackets, found from each [at] outwards, so that long runs are walked once."""
    last = 0
    for m in AT.finditer(text):
        start, domain = m.start(), SPELLED.match(text, m.end())
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        if domain and start < m.start():
            last = domain.end()
            yield start, last


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Whole values of 8 characters or more assigned to a name for secrets, and runs of 16 or more with a letter and a digit."""
    last = 0
    for m in ASSIGN.finditer(text):
        if m.start() >= last and NAMED.search(text[max(0, m.start() - 24) : m.start()]):
            value = VALUE.match(text, m.end())
            if value:
                last = value.end()
                yield value.span(1)
    last = 0
    for m in DIGITS.finditer(text):
        start = m.start()
        if start >= last:
            while start > last and text[start - 1] in IN_RUN:
                start -= 1
            last = RUN.match(text, start).end()
            if last - start >= 16 and any(c.isalpha() for c in text[start:last]):
                yield start, last


def loose(text: str, base: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, bool]]:
    """Candidates of the added kinds that touch no base span and no candidate before them.

    A secret may hold base spans inside: digits of a long one pass the test for cards by chance, and the rest of it
    must not stay.
    """
    out: list[tuple[str, int, int, bool]] = []
    held = ([], [])  # starts and ends of the base spans, those that overlap as one
    for start, end in sorted((a, b) for _, a, b, ok in base if ok):
        if held[1] and start < held[1][-1]:
            held[1][-1] = max(held[1][-1], end)
        else:
            held[0].append(start)
            held[1].append(end)
    taken = ([], [])

    def offer(kind: str, start: int, end: int) -> None:
        i, j = bisect.bisect_right(held[1], start), bisect.bisect_left(held[0], end)
        inside = i < j and kind == "secret" and start <= held[0][i] and held[1][j - 1] <= end and end - start > held[1][j - 1] - held[0][i]
        k = bisect.bisect_right(taken[1], start)
        if (i == j or inside) and k == bisect.bisect_left(taken[0], end):
            out.append((kind, start, end, True))
            taken[0].insert(k, start)
            taken[1].insert(k, end)

    if "at]" in text or "at)" in text:
        for start, end in spelled_emails(text):
            offer("email_spelled", start, end)
    for kind, pattern in LOOSE.items():
        for m in pattern.finditer(text):
            offer(kind, *m.span())
    for start, end in secrets(text):
        offer("secret", start, end)
    return out


def entropy(said: str) -> float:
    n = len(said)
    return -sum(k / n * math.log2(k / n) for k in Counter(said).values()) if n else 0.0


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> int:
    """The LABELERS' votes in base 3, each 0 against, 1 abstaining, 2 for."""
    said, family = text[start:end], kind.split("_")[0]
    digits = re.sub("[^0-9]", "", said)
    if kind in KINDS:
        shape = 2 if strict else 0
    elif kind == "email_spelled":
        shape = 2 if re.search(r"[A-Za-z]{2,6}$", said) else 0
    elif kind == "phone_local":
        shape = 0 if digits[0] in "01" or digits[3] in "01" else 2 if said[0] == "(" else 1
    elif kind == "ssn":
        shape = 0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    else:
        words = [w for w in re.split(r"[^A-Za-z0-9]+", said) if w]
        plain = all(w.isalpha() or w.isdigit() for w in words)
        shape = 0 if plain else 2 if re.fullmatch(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})", said) else 1
    if family == "email":
        listed = 2 if re.split(r"[^A-Za-z0-9]+", said.rstrip("]).")).pop().lower() in ENDINGS else 1
    elif family == "card":
        listed = 2 if digits.startswith(ISSUERS) else 1
    elif family == "ip":
        listed = 0 if digits[:1] == "0" else 1
    elif family == "phone":
        listed = 2 if digits[-7:-4] == "555" or digits.startswith("1") else 1
    elif family == "secret":
        listed = 2 if said.startswith(ISSUED) else 0 if any(x in said.lower() for x in FILLERS) else 1
    else:
        listed = 1
    before = text[max(0, start - 40) : start]
    cue, counter = 2 if CUE[family].search(before) else 1, 0 if NOT.search(before) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    if left.isalnum() or right.isalnum() or left in ("/", "#") or (left == "=" and family != "secret"):
        apart = 0
    else:
        apart = 2 if re.search(r"[:=]\s*['\"]?$", before) else 1
    if family == "secret":
        bits = entropy(said)
        variety = 2 if bits >= 3.4 else 0 if bits < 2.2 else 1
    else:
        variety = 0 if family != "email" and (len(set(digits)) < 2 or digits in "01234567890123456789") else 1
    return shape + 3 * listed + 9 * cue + 27 * counter + 81 * apart + 243 * variety


def slots_of(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span for the classifier: its characters by class, its length and variety, the words around it.

    They are other views than the labelers' votes: what goes with the spans that several labelers support is learned from
    the spans, and then holds where the labelers are silent.
    """
    said = text[start:end]
    shape = "".join("d" if c.isdigit() else "x" if c in "abcdef" else "l" if c.islower() else "U" if c.isupper() else c for c in said)
    left, right = re.findall(r"\w+|[^\w\s]", text[max(0, start - 48) : start].lower())[-4:], re.findall(r"\w+|[^\w\s]", text[end : end + 24].lower())[:2]
    names = {f"kind {kind}", f"{kind} {min(len(said), 64) // 4}", f"{kind} variety {int(2 * entropy(said))}", f"classes {''.join(sorted(set(shape)))[:12]}"}
    names |= {f"shape {shape[i : i + 2]}" for i in range(len(shape) - 1)} | {f"left {w}" for w in left} | {f"right {w}" for w in right}
    names |= {f"near {' '.join(left[-2:])}", f"touch {text[start - 1 : start]}{text[end : end + 1]}"}
    return sorted({zlib.crc32(n.encode()) % SLOTS for n in names})


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> counts, digest and spans of the base, and the candidates of every kind with votes and features."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    cand = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("slots", pa.list_(pa.int32()))])
    for batch in batches:
        counts, digest, base, found = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            all_ = matches(text)
            ok = [x[:3] for x in all_ if x[3]]
            counts.append([sum(k == x[0] for x in ok) for k in KINDS])
            digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in ok).encode()).hexdigest())
            base.append([dict(zip(("kind", "start", "end"), x)) for x in ok])
            found.append([{"kind": k, "start": a, "end": b, "votes": votes(text, k, a, b, s), "slots": slots_of(text, k, a, b)} for k, a, b, s in all_ + loose(text, all_)])
        n = np.array(counts, np.int64).reshape(-1, len(KINDS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(cand))],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "found"],
        )
    let_go()


SPAN = "struct<kind:string,start:bigint,end:bigint>"
FOUND = "struct<kind:string,start:bigint,end:bigint,votes:int,slots:array<int>>"


def scanned(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base array<{SPAN}>, found array<{FOUND}>")


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, known: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """P(personal | votes) of each vote pattern (patterns x labelers, 0..2), labelers independent given the truth.

    Starts from a majority vote; the table of each labeler, P(vote | truth), is smoothed by one and by BELIEF. Both truths are taken to
    be as likely beforehand, so that the larger one does not draw the other's patterns over. Where `known` is 1 or 0
    that is the truth: matches of the base patterns are personal data, and those that fail their tests are not.
    """
    known = np.full(len(count), np.nan) if known is None else known
    sure = ~np.isnan(known)
    p = np.where(sure, np.nan_to_num(known), 1 / (1 + np.exp(-(pattern - 1).sum(1).astype(float))))
    for _ in range(rounds):
        one, two = np.zeros(len(count)), np.zeros(len(count))
        for j in range(pattern.shape[1]):
            yes = np.bincount(pattern[:, j], p * count, 3) + 1
            no = np.bincount(pattern[:, j], (1 - p) * count, 3) + 1
            # a labeler is taken to be better than chance, which keeps the two truths from changing places
            yes, no = yes / yes.sum() + BELIEF, no / no.sum() + BELIEF[::-1]
            yes, no = yes / yes.sum(), no / no.sum()
            if yes[2] * no[0] < yes[0] * no[2]:
                yes = no = (yes + no) / 2
            one, two = one + np.log(yes)[pattern[:, j]], two + np.log(no)[pattern[:, j]]
        p = np.where(sure, p, 1 / (1 + np.exp(np.clip(two - one, -500, 500))))
    return p


def span_classifier(slots: list[list[int]], p: np.ndarray, rounds: int = 200, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on hashed features, the last one the bias, fitted to the soft labels p."""
    n = np.array([len(x) for x in slots])
    row = np.repeat(np.arange(len(slots)), n + 1)
    flat = np.concatenate([np.array([*x, SLOTS], np.int64) for x in slots])
    value = 1 / np.sqrt(n + 1.0)[row]
    w, h = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8)
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat] * value, len(slots)), -30, 30)))
        g = np.bincount(flat, (score - p)[row] * value, SLOTS + 1) / len(slots) + l2 * w
        h += g * g
        w -= rate * g / np.sqrt(h)
    return w


def span_score(weights: np.ndarray, slots: list[int]) -> float:
    at = [*slots, SLOTS]
    return float(1 / (1 + np.exp(-np.clip(weights[at].sum() / math.sqrt(len(at)), -30, 30))))


def fit_pii(candidates: DataFrame, bound: int = 20000) -> np.ndarray:
    """candidates(key, kind, votes, slots) -> the span classifier's weights; without candidates they are 0 and accept nothing.

    The labelers' reliabilities come from the counts of vote patterns over all candidates: at most twice 729
    patterns leave the executors. The classifier is fitted on the candidates whose `key`, a hash, is below bound / all:
    all of them, or about `bound` if there are more.
    """
    base = F.col("kind").isin(*KINDS)
    rows = candidates.groupBy(base.alias("base"), "votes").count().orderBy("base", "votes").collect()
    if not rows:
        return np.zeros(SLOTS + 1)
    code, count = np.array([r["votes"] for r in rows]), np.array([r["count"] for r in rows], float)
    pattern = code[:, None] // 3 ** np.arange(len(LABELERS)) % 3
    p = expectation_maximisation(pattern, count, np.where([r["base"] for r in rows], pattern[:, 0] // 2, np.nan))
    label = {(r["base"], r["votes"]): x for r, x in zip(rows, p.tolist())}
    few = candidates.where(F.pmod("key", F.lit(1 << 40)) < int(min(1.0, bound / count.sum()) * (1 << 40))).select(base.alias("base"), "votes", "slots").orderBy("base", "votes", "slots").collect()
    return span_classifier([r["slots"] for r in few], np.array([label[r["base"], r["votes"]] for r in few])) if few else np.zeros(SLOTS + 1)


def candidates_of(scan_: DataFrame) -> DataFrame:
    return scan_.select("doc_id", F.explode("found").alias("f")).select(F.xxhash64("doc_id", "f.kind", "f.start").alias("key"), "f.kind", "f.votes", "f.slots")


def find_pii(documents: DataFrame, save: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.8) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans).

    Base spans stay as they are. Six labelers vote on every candidate, expectation-maximisation tells how far each is to
    be trusted and so how likely each pattern of votes is, and a classifier of a span's characters and surroundings,
    trained on that, adds the spans of the kinds in ADDED that it scores `threshold` or more; these touch no base span.
    Two narrow passes and small aggregates. `save` keeps the scan between them (a function of a DataFrame), else it runs
    anew. Null texts have no spans; repeated rows are judged each; an empty table gives no row; other columns are ignored.
    """
    found = scanned(documents)
    found = save(found) if save else found
    weights = found.sparkSession.sparkContext.broadcast(fit_pii(candidates_of(found)))  # SLOTS + 1 numbers
    order = {k: i for i, k in enumerate(KINDS + ADDED)}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n = [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist()):
                all_ = base + [f for f in more if f["kind"] in ADDED and span_score(weights.value, f["slots"]) >= threshold]
                all_.sort(key=lambda f: (order[f["kind"]], f["start"]))
                spans.append(",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in all_))
                n.append(len(all_))
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.string()), pa.array(n, pa.int64())], [*names, "spans", "n_spans"])
        let_go()

    kept = [f"n_{k}" for k in KINDS]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", *kept, "base_sha256", "base", "found").mapInArrow(decide, f"doc_id {kind}, {', '.join(f'{k} long' for k in kept)}, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kinds in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same rows and columns with personal data in `text` replaced by <kind>, and n_chars, if there, counted anew.

    Null texts stay null; ids may be null or repeated, as they only draw the classifier's sample; columns may have any
    name; an empty table gives no row.
    """
    candidates = saved(candidates_of(scanned(documents)), "candidates")
    weights = documents.sparkSession.sparkContext.broadcast(fit_pii(candidates))  # SLOTS + 1 numbers
    forget(candidates)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                if text:
                    base = matches(text)
                    spans = [(a, b, k) for k, a, b, ok in base if ok]
                    spans += [(a, b, k) for k, a, b, _ in loose(text, base) if span_score(weights.value, slots_of(text, k, a, b)) >= threshold]
                    text = masked(text, spans) if spans else text
                out.append(text)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field("text").type) if n == "text" else batch.column(i) for i, n in enumerate(names)], names)
        let_go()

    done = documents.mapInArrow(mask, StructType([*documents.schema.fields]))
    return done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else done
