"""PII: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier decides.

* Base spans come from the four contract patterns and checks; they always stay.
* Candidates are base spans and what wider patterns match: spelled-out addresses, numbers in telephone
  layout without a plus sign, digit groups in card layout, and secrets: long runs of letters and digits. A card
  or telephone match that fails as a whole proposes the parts of it that pass: cards standing side by side, a number before other digits.
* Labelers vote 1, 0 or abstain (2) on each candidate: the contract's check, the layout, a gazetteer (mail domains,
  card number starts, country codes, names of secrets), the context before the span, and the characters beside it. The check votes
  3 on a part: it passes, yet that doesn't settle the case, since a part can pass by chance.
* Votes are counted by kind and pattern over all documents (grouped aggregation; the number of patterns is
  bounded by the labelers). EM on these counts (Dawid-Skene, one coin for each labeler and class) gives each
  pattern a posterior. What a check decides is known: a span that passes is personal data, one that fails isn't; these
  anchor the reliabilities of the other labelers. Where there is no check, EM decides. Reliabilities are shrunk
  halfway to BELIEF and priors to 1/2, so that labelers without known cases don't confirm each other.
* A logistic regression on the votes is trained on the posteriors and decides on
  candidates that aren't base spans. One that overlaps a base span is never added.

Defined cases: a null text counts as empty and has no spans. Rows are independent given the pattern counts; repeated rows repeat their
result. An empty table gives an empty result. All matching is linear in the text's length, also on runs
of one character. Offsets are code points, ends exclusive. Extra columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import small_batches, tidy, written

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in their order in a list of spans; the last is only found by the method.
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("check", "layout", "gazetteer", "context", "beside")
ABSTAIN, PART = 2, 3
#: Posterior from which a candidate that isn't a base span is added.
THRESHOLD = 0.9
#: What a labeler's reliability is before any vote, and how much that weighs against its votes.
BELIEF, WEIGHT = 0.75, 1.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins, so later starts in the run needn't be tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]{3}|\+")
#: What every card holds.
_PAIR = re.compile(r"[0-9][\x20-]?[0-9]")
_SPELLED = re.compile(r"(?<![\w.@])[A-Za-z0-9][A-Za-z0-9._-]{0,63}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}(?!\w)")
_LAYOUT = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])")
_CONTEXT = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|write|reach)\W{0,3}(?:\w{1,12}\W{1,3}){0,3}$"),
    "ip": re.compile(r"(?i)(?:\bip\b|address|host|server|login)\W{0,3}(?:\w{1,12}\W{1,3}){0,3}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|payment|account)\W{0,3}(?:\w{1,12}\W{1,3}){0,3}$"),
    "phone": re.compile(r"(?i)(?:\btel\b|phone|call|mobile|fax|whatsapp)\W{0,3}(?:\w{1,12}\W{1,3}){0,3}$"),
}
# a run of key characters, from its first one on
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|credentials?|bearer|auth)\W{0,6}$")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_ASSIGNED = re.compile(r"[:=] ?[\"']?$")
#: Lengths of keys and digests in hexadecimal.
_BLANK = ("", " ", "\t", "\n", "\r")
_HEX_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: Country codes after the plus sign.
_COUNTRY = re.compile(r"\+ ?\(?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[058]|9[679])[0-9])")
_GROUP = re.compile(r"[0-9]+")
_TOP = frozenset("com org net edu gov io de fr es uk eu info".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, from its @ signs outward."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes the check) of every match of the four patterns."""
    out = []
    if "@" in text:
        out += [(s, e, "email", True) for s, e in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            out.append((m.start(), m.end(), "ip", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))))
    if _PAIR.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                out.append((m.start(), m.end(), "card", 12 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((m.start(), m.end(), "phone", 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def card_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Runs of whole digit groups inside a failed card match that pass on their own, leftmost first, not overlapping.

    From a group on, at most 19 digits are read, so this is linear in the match.
    """
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    out, i = [], 0
    while i < len(groups):
        digits, took = "", 0
        for j in range(i, len(groups)):
            if groups[j][1] - groups[j][0] > 19 - len(digits):
                break
            digits += text[groups[j][0] : groups[j][1]]
            if len(digits) >= 12 and (i or j < len(groups) - 1) and luhn(digits):
                out.append((groups[i][0], groups[j][1]))
                took = j + 1 - i
                break
        i += took or 1
    return out


def phone_part(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The shortest run of whole digit groups from the plus sign of a failed match on that has 9 to 15 digits."""
    digits = 0
    for m in _GROUP.finditer(text, start, end):
        digits += m.end() - m.start()
        if digits >= 9:
            return [(start, m.end())] if digits <= 15 and m.end() < end else []
    return []


def _bits(span: str) -> float:
    """Bits a character, by the characters' shares."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def votes(text: str, start: int, end: int, kind: str, check: int) -> str:
    """One digit for each labeler: 1 for, 0 against, 2 abstains."""
    span, left = text[start:end], text[max(0, start - 40) : start]
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        layout = 1 if len(span) <= 254 else 0
        gazetteer = 1 if re.split(r"[\W_]", span.lower())[-1] in _TOP else ABSTAIN
    elif kind == "card":
        groups = re.split(r"[ -]", span)
        layout = 1 if len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]) else 0
        gazetteer = 1 if span[0] in "3456" else 0
    elif kind == "phone":
        layout = 1 if re.search(r"[0-9]{3}[-. )]+[0-9]{3,4}", span) else ABSTAIN
        gazetteer = ABSTAIN if span[0] != "+" else 1 if _COUNTRY.match(span) else 0
    elif kind == "secret":
        hexadecimal = not span.strip("0123456789abcdefABCDEF") and len(span) in _HEX_LENGTHS
        mixed = not (span.islower() or span.isupper()) and len(span) >= 20
        layout = 1 if (hexadecimal or mixed) and _bits(span) >= 3 else 0
        gazetteer = 1 if _NAME.search(left) else ABSTAIN
        quoted = before in ("'", '"') and before == after
        return f"{check}{layout}{gazetteer}{1 if _ASSIGNED.search(left) else 0}{1 if quoted or before in _BLANK and after in _BLANK else 0}"
    else:
        layout = 1 if not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 0
        gazetteer = 0 if span.startswith("0.") else ABSTAIN
    context = 1 if _CONTEXT[kind].search(left) else 0
    beside = 0 if before.isalnum() or after.isalnum() or before in ("-", "/", "=") and before else 1
    return f"{check}{layout}{gazetteer}{context}{beside}"


def candidates(text: str | None) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, is base span, votes), base spans first."""
    text = text or ""
    found = base_spans(text)
    out = [(s, e, k, True, votes(text, s, e, k, 1)) for s, e, k, ok in found if ok]
    wide = [(s, e, k, 0) for s, e, k, ok in found if not ok]
    for s, e, k, _ in list(wide):
        wide += [(a, b, k, PART) for a, b in (card_parts(text, s, e) if k == "card" else phone_part(text, s, e) if k == "phone" else ())]
    if "dot" in text:
        wide += [(m.start(), m.end(), "email", ABSTAIN) for m in _SPELLED.finditer(text)]
    if _DIGITS.search(text):
        wide += [(m.start(), m.end(), "phone", ABSTAIN) for m in _LAYOUT.finditer(text)]
    for m in _KEY.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            wide.append((m.start(), m.end(), "secret", ABSTAIN))
    # base spans merged to disjoint intervals, searched by their starts
    starts, ends = [], []
    for s, e in sorted((s, e) for s, e, *_ in out):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for s, e, k, check in sorted(wide, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        at = bisect.bisect_left(starts, e)
        if not at or ends[at - 1] <= s:
            out.append((s, e, k, False, votes(text, s, e, k, check)))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


_FOUND = "base string, n_email long, n_ip long, n_card long, n_phone long, wide array<struct<s:int,e:int,kind:string,votes:string>>, seen array<string>"


def found_column(text: Column) -> Column:
    """Struct _FOUND: base spans, the candidates beside them, and kind + votes of all."""

    def rows_of(batches):
        for batch in batches:
            rows = []
            for text in batch:
                got = candidates(text)
                base = [x[:3] for x in got if x[3]]
                rows.append(
                    (
                        joined(base),
                        *[sum(x[2] == k for x in base) for k in BASE_KINDS],
                        [{"s": s, "e": e, "kind": k, "votes": v} for s, e, k, is_base, v in got if not is_base],
                        [f"{k}/{v}" for _, _, k, _, v in got],
                    )
                )
            yield pd.DataFrame(rows, columns=["base", *[f"n_{k}" for k in BASE_KINDS], "wide", "seen"])

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy("pii", rows_of)(batches)

    return find(text)


def _reliability(weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of its votes that each labeler casts right, shrunk to BELIEF; never 0 or 1."""
    n = weight.sum(0)
    return ((weight * right).sum(0) + (WEIGHT * n + 1) * BELIEF) / (n + WEIGHT * n + 1)


def estimate(counts: dict[tuple[str, str], int], rounds: int = 100) -> dict[tuple[str, str], float]:
    """EM over vote patterns: the posterior that a span with (kind, votes) is personal data.

    A labeler's reliabilities hold for all kinds, so that a kind without checks learns from those that have some; each kind has its own prior.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    kind = np.array([KINDS.index(k) for k, _ in keys])
    v = np.array([[int(c) for c in x] for _, x in keys])
    n = np.array([counts[k] for k in keys], float)
    passed, failed = v[:, 0] == 1, v[:, 0] == 0
    v[v == PART] = 1
    cast = v != ABSTAIN
    open_ = ~(passed | failed)
    post = (np.where(cast, v, 0).sum(1) + 0.5) / (cast.sum(1) + 1)
    for _ in range(rounds):
        post = np.where(passed, 1.0, np.where(failed, 0.0, post))
        # the prior is that of the kind's candidates without a check, shrunk halfway to 1/2
        good, all_ = (np.bincount(kind, open_ * x, len(KINDS)) for x in (n * post, n))
        prior = ((good + (WEIGHT * all_ + 1) / 2) / (all_ + WEIGHT * all_ + 1))[kind]
        one, zero = (_reliability((n * p)[:, None] * cast, v == k) for k, p in ((1, post), (0, 1 - post)))
        yes = np.where(cast, np.where(v == 1, np.log(one), np.log(1 - one)), 0).sum(1) + np.log(prior)
        no = np.where(cast, np.where(v == 0, np.log(zero), np.log(1 - zero)), 0).sum(1) + np.log(1 - prior)
        post = np.where(open_, 1 / (1 + np.exp(np.clip(no - yes, -50, 50))), post)
    return {k: float(p) for k, p in zip(keys, post, strict=True)}


def span_features(kind: str, v: str) -> np.ndarray:
    x = [1.0, *[float(kind == k) for k in KINDS]]
    for c in v:
        x += [float(c in "13"), float(c == "0")]
    return np.array(x)


def classifier(counts: dict[tuple[str, str], int], posteriors: dict[tuple[str, str], float], rounds: int = 60, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on votes, trained on the posteriors as soft labels (Newton's method)."""
    keys = sorted(counts)
    w = np.zeros(len(span_features("email", "2" * len(LABELERS))))
    if not keys:
        return w
    x = np.stack([span_features(*k) for k in keys])
    n = np.log1p(np.array([counts[k] for k in keys], float))
    y = np.array([posteriors[k] for k in keys])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.01 * l2 * w
        hess = (x.T * (n * p * (1 - p))) @ x + 0.01 * l2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w


def accepted(counts: dict[tuple[str, str], int], threshold: float = THRESHOLD) -> list[str]:
    """kind/votes that the classifier takes as personal data."""
    w = classifier(counts, estimate(counts))
    return sorted(f"{k}/{v}" for k, v in counts if 1 / (1 + math.exp(-float(np.clip(span_features(k, v) @ w, -30, 30)))) >= threshold)


def pattern_counts(found: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Counts of kind/votes over all documents: at most 5 * 4 * 3^4 rows reach the driver."""
    rows = found.select(F.explode(F.col(column)["seen"]).alias("p")).groupBy("p").count().collect()
    return {tuple(r["p"].split("/")): r["count"] for r in rows}


def all_spans(found: Column, take: list[str]) -> Column:
    """All spans of a struct _FOUND as one string: base spans and the accepted candidates, by start, then kind."""

    @F.pandas_udf("string")
    def merge(base: pd.Series, wide: pd.Series) -> pd.Series:
        yes, out = set(take), []
        for b, w in zip(base, wide, strict=True):
            spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in b.split(",") if x)]
            last = -1
            for x in w if w is not None else ():
                if f"{x['kind']}/{x['votes']}" in yes and x["s"] >= last:
                    spans.append((x["s"], x["e"], x["kind"]))
                    last = x["e"]
            out.append(joined(spans))
        return pd.Series(out)

    return merge(found["base"], found["wide"])


def find_spans(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, counts of base spans, base_sha256, spans, and how many of them were added.

    n_parts counts parts of failed matches, n_added all others.
    """
    small_batches(docs.sparkSession)
    found = written(docs.select("doc_id", found_column(F.col("text")).alias("f")), "pii")
    take = accepted(pattern_counts(found, "f"))
    rows = found.select(
        "doc_id", *[F.col("f")[f"n_{k}"].alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.col("f")["base"].cast("binary"), 256).alias("base_sha256"),
        F.transform(F.filter(F.col("f")["wide"], lambda w: w["votes"].startswith(str(PART))), lambda w: F.concat_ws(":", w["kind"], w["s"], w["e"])).alias("parts"),
        F.when(F.size(F.col("f")["wide"]) == 0, F.col("f")["base"]).otherwise(all_spans(F.col("f"), take)).alias("spans"),
    )
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    n_parts = F.size(F.array_intersect(F.split("spans", ","), F.col("parts"))).cast("long")
    rows = rows.withColumn("n_parts", n_parts).drop("parts")
    return rows.withColumn("n_added", (n_spans - sum(F.col(f"n_{k}") for k in BASE_KINDS)).cast("long") - F.col("n_parts"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in angle brackets; null texts stay null.

    Texts are searched twice, once for the pattern counts and once to mask; they aren't written between.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(found_column(F.col("text")).alias("f"))
    take = accepted(pattern_counts(counted, "f"))
    yes = set(take)

    def hidden(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            spans = sorted(x[:3] for x in candidates(text) if x[3] or f"{x[2]}/{x[4]}" in yes)
            parts, last = [], 0
            for s, e, k in spans:
                if s >= last:
                    parts += [text[last:s], f"<{k.upper()}>"]
                last = max(last, e)
            out.append("".join([*parts, text[last:]]) if spans else text)
        return pd.Series(out, dtype="object")

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy("pii", lambda b: map(hidden, b))(batches)

    return docs.withColumn("text", mask(F.col("text")))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
