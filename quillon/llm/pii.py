"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are found by wide patterns; each labeler - a strict pattern, a
check (Luhn, octets, digit count), a gazetteer (mail domains, private address
ranges, card issuers, calling codes) or a context window - votes for, against
or abstains.  Expectation-maximisation over the counts of vote patterns
estimates, for each kind, the share of true spans and every labeler's
reliability, without labels.  The posteriors then train a final logistic
classifier on span features, which decides about the candidates that the base
patterns do not already prove.  Base spans are always kept.

Scale: two passes over the texts' spans, no shuffle of texts; what is
gathered is one row for each kind, vote pattern and feature pattern, whose
number is bounded by the labelers and features, not by the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import shared_dir, small_batches, stored

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that does not begin where its run of digits begins cannot begin within it, so the look-behind changes nothing.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider patterns for further candidates.
_EMAIL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_PHONE_BARE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9-])")

#: Words that speak for a kind within 40 characters before a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono"),
}
#: Words that speak against any kind.
AGAINST = ("version", "isbn", "token", "order", "id", "serial", "hash")
#: Top-level domains, card issuers' first digits and calling codes that are common.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "example")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")

LABELERS = ("strict", "check", "gazetteer", "context", "against", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base e-mail pattern, found from each @ outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _USER:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at)
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Base spans and wider candidates that do not meet one: (start, kind number, end, base)."""
    base = [(s, k, e, True) for s, k, e in base_spans(text)]
    more = []
    low = text.lower()
    if " at " in low or "(at" in low or "[at" in low or "( at" in low or "[ at" in low:
        more += [(m.start(), 0, m.end()) for m in _EMAIL_AT.finditer(text)]
    if text.count(":") >= 7:
        more += [(m.start(), 1, m.end()) for m in _IPV6.finditer(text)]
    if any(c in text for c in "0123456789"):
        more += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
        more += [(m.start(), 3, m.end()) for m in _PHONE_BARE.finditer(text)]
    taken: list[list[int]] = []  # what base spans cover, in runs
    for s, _, e, _ in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    starts, last = [s for s, _ in taken], 0
    for s, k, e in sorted(more):
        i = bisect_left(starts, e)  # runs that begin before the candidate ends: only the last one can reach into it
        if s >= last and not (i and taken[i - 1][1] > s):
            base.append((s, k, e, False))
            last = e
    return sorted(base)


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    span, name = text[start:end], KINDS[kind]
    before = text[max(0, start - 40) : start].lower()
    d = _digits(span)
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", before))
    context = 1 if words & set(CONTEXT[name]) else 0
    against = -1 if words & set(AGAINST) else 0
    strict = 1 if base else -1
    if kind == 0:
        tail = span.rpartition(".")[2].rpartition(" ")[2].lower()
        return strict, 1 if "@" in span else -1, 1 if tail in DOMAINS else -1, context, against, 1 if len(span) <= 254 and ".." not in span else -1
    if kind == 1:
        parts = span.split(".")
        return strict, 1 if len(parts) == 4 or ":" in span else -1, -1 if span.startswith(("0.", "255.")) else 1, context, against, -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    if kind == 2:
        return strict, 1 if luhn(d) else -1, 1 if d.startswith(ISSUERS) else -1, context, against, 1 if len(d) in (15, 16) else -1
    return strict, 1 if 9 <= len(d) <= 15 else -1, 1 if span.startswith("+") and d.startswith(CALLING) else 0, context, against, 1 if "(" in span or "-" in span or " " in span else -1


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse span features for the classifier: length, share of digits, marks, and what stands around."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    left, right = text[start - 1 : start], text[end : end + 1]
    return min(7, (end - start) // 4), round(3 * digits / max(1, end - start)), int("@" in span), int("." in span), int("+" in span), int(left.isalnum()), int(right.isalnum())


FEATURE_SIZES = (8, 4, 2, 2, 2, 2, 2)


def _code(values: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    out = 0
    for v, n in zip(values, sizes):
        out = out * n + v
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))
    for b in batches:
        texts, at = b.column("text"), 0
        while at < len(texts):  # a few at a time: texts may be long
            part = texts.slice(at, 256)
            rows = []
            for text in part.to_pylist():
                rows.append([])
                for s, k, e, base in candidates(text or ""):
                    v = votes(text, s, k, e, base)
                    rows[-1].append({"start": s, "kind": k, "end": e, "base": base, "votes": _code(tuple(x + 1 for x in v), (3,) * len(v)), "features": _code(features(text, s, e), FEATURE_SIZES)})
            yield pa.RecordBatch.from_arrays([b.column("key").slice(at, 256), pa.array(rows, kind)], ["key", "spans"])
            at += 256


def _decode(code: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    cols = []
    for n in reversed(sizes):
        cols.append(code % n)
        code = code // n
    return np.stack(cols[::-1], axis=1)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of true spans, P(vote | truth) as (2, labelers, 3), and each pattern's posterior.

    ``patterns`` has a vote of 0 (against), 1 (abstains) or 2 (for) for each
    labeler; starts from the majority vote, which also names the classes.
    """
    votes_for = (patterns == 2).sum(1) - (patterns == 0).sum(1)
    post = 1 / (1 + np.exp(-votes_for.astype(float)))
    eye = np.eye(3)[patterns]  # (patterns, labelers, 3)
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        share = (w[1].sum() + 1) / (counts.sum() + 2)
        theta = np.einsum("cp,plv->clv", w, eye) + 0.5
        theta /= theta.sum(2, keepdims=True)
        like = np.einsum("plv,clv->cp", eye, np.log(theta))
        odds = np.log(share) - np.log(1 - share) + like[1] - like[0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return share, theta, post


def fit_classifier(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method (last weight: the bias)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - soft)) + ridge * w
        hess = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _design(votes_code: np.ndarray, feature_code: np.ndarray) -> np.ndarray:
    """One-hot features, and the votes of the labelers other than ``strict``."""
    f = _decode(feature_code, FEATURE_SIZES)
    hot = [np.eye(n)[f[:, i]] for i, n in enumerate(FEATURE_SIZES)]
    return np.hstack([*hot, _decode(votes_code, (3,) * len(LABELERS))[:, 1:] - 1.0])


def learn(patterns: list[tuple[int, int, int, int]]) -> tuple[dict[tuple[int, int, int], float], dict[str, dict]]:
    """From (kind, votes, features, count): the probability of each combination, and what EM found for each kind."""
    out, report = {}, {}
    for k, name in enumerate(KINDS):
        rows = sorted(r for r in patterns if r[0] == k)
        if not rows:
            continue
        v, f, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        codes, back = np.unique(v, return_inverse=True)
        counts = np.bincount(back, weights=n)
        share, theta, post = em(_decode(codes, (3,) * len(LABELERS)), counts)
        x = _design(v, f)
        w = fit_classifier(x, post[back], n.astype(float))
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        out |= {(k, int(a), int(b)): float(c) for a, b, c in zip(v, f, p)}
        report[name] = {"share": share, "reliability": {label: float(theta[1, i, 2] / (theta[1, i, 2] + theta[0, i, 2])) for i, label in enumerate(LABELERS)}}
    return out, report


def find_pii(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """For each row: key and ``spans``, an array of start, kind, end, base, score ordered by start, then kind.

    Starts and ends are code points, ends exclusive.  Base spans (score 1) are
    always there; other candidates if the classifier gives them ``threshold``.

    Defined cases: a null or empty text has no spans.  Rows are judged alone,
    so repeated rows and keys come back as often.  Candidates that overlap a
    base span or an earlier candidate are left out.  A table without any
    candidate, or an empty one, learns nothing and gives no further spans.
    Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.select("key").schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_find, f"key {kind}, spans array<struct<start:int,kind:int,end:int,base:boolean,votes:int,features:int>>")
    found = stored(found, shared_dir(docs.sparkSession, "pii"))
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count()
    prob, _ = learn([tuple(r) for r in counted.collect()])  # one row for each pattern: bounded by labelers and features
    good = sorted([k, v, f, p] for (k, v, f), p in prob.items() if p >= threshold)
    spark = docs.sparkSession
    if good:
        table = spark.createDataFrame([(f"{k}:{v}:{f}", p) for k, v, f, p in good], "code string, p double").agg(F.map_from_entries(F.collect_list(F.struct("code", "p"))).alias("good"))
        found = found.crossJoin(F.broadcast(table))  # one row
    else:
        found = found.withColumn("good", F.expr("map('', 0.0d)"))
    score = lambda s: F.when(s["base"], F.lit(1.0)).otherwise(F.try_element_at("good", F.concat_ws(":", s["kind"], s["votes"], s["features"])))
    kept = F.filter(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), score(s).alias("score"))), lambda s: s["score"].isNotNull())
    return found.select(F.col("key").alias(key), kept.alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """Replaces the found spans by ``<KIND>``; ``key`` must identify rows.  Null texts stay null."""
    found = find_pii(docs, text=text, key=key, threshold=threshold).select(F.col(key).alias("_key"), F.col("spans").alias("_spans")).filter(F.size("_spans") > 0)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out")))
    cut = F.aggregate("_spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))))
    out = docs.join(found, docs[key] == F.col("_key"), "left")
    return out.withColumn(text, F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col(text))).drop("_key", "_spans")
