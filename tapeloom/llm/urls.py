"""URL filters: longest-prefix rules first, then a logistic regression on hashed character n-grams of host and path.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on to ``?``,
``#`` or the end. A rule such as ``example.net/en/`` fits its host and all subdomains whose path starts with
the rule's (from its first slash); the longest fitting rule wins. Without one the regression decides:
block at a probability of one half or more.

The regression is trained on a labelled table built by rule from word lists (``labelled_urls``); n-grams of three to five characters, host and path apart, count once
per URL in 2**16 buckets. Pairs of words in _LEFT_OUT are kept out of the table: names of the given pages are judged unseen.

Edge cases: a null URL or one without ``://`` has an empty host and path, no n-grams and the verdict allow; equal rules
with other verdicts: the later one in the list wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import sigmoid
from tapeloom.llm.textbytes import mix64

#: Words of the labelled table: what is blocked, what is not, and what stands beside either.
BLOCKED_WORDS = (
    "casino poker slots jackpot roulette bets betting lotto pills meds pharma steroids potency diet ads adserver banner popups tracker tracking "
    "clicks pixel spam seo backlinks junk adult xxx cams nude escort erotic").split()
CLEAN_WORDS = (
    "library museum garden school weather recipes science history music travel forum code maps books health council news sports theatre bakery "
    "hotel river mountain kitchen bicycle camera poetry language chemistry physics market press winter trains animal doctor street island reading cooking hiking knitting painting writing").split()
BESIDE = "best free cheap mega royal online super hot top win fast live easy bonus farm x".split()
#: Parts of invented clean names.
SYLLABLES = "ba ker lo mi nor pa sel tur va den gri hom jal kes lun mor ner pol qui ras".split()
_SUFFIXES = ("test", "example.com", "example.org", "example.net")
_PATHS = ("/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}?page=2", "/{n}", "/articles/{n}", "/")
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BUCKET_BITS = 16
GRAMS = (3, 4, 5)
#: (word, beside) of names that must stay unseen, for an honest test.
_LEFT_OUT = {("casino", "win"), ("bets", "free"), ("pills", "cheap"), ("spam", "farm"), ("adult", "x")}
_AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AUTHORITY, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; the rules are a short list of the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled URL table, (url, 1 to block or 0 to allow), by rule.

    Each blocked and each clean word stands next to each word of BESIDE, before it and after it, with and without a hyphen, so only the
    word itself tells the kind; invented names of two or three syllables are clean. Suffixes, subdomains and paths go round alike.
    """
    names = [(name, label) for words, label in ((BLOCKED_WORDS, 1), (CLEAN_WORDS, 0)) for word in words for other in BESIDE
             for name in (f"{word}-{other}", f"{other}-{word}", f"{other}{word}") if (word, other) not in _LEFT_OUT]
    names += [(a + b + c, 0) for i, a in enumerate(SYLLABLES) for b in SYLLABLES for c in ("", SYLLABLES[i - 7])]
    return [
        (f"http{'s' * (k % 2)}://{('', 'www.', 'm.', 'blog.')[k % 4]}{name}.{_SUFFIXES[k % 7 % 4]}{_PATHS[k % 7].format(n=k * 37 % 9_973)}", label)
        for k, (name, label) in enumerate(names)]


def grams(hosts: list[str | None], paths: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), once each, of the character n-grams of all rows; every part is framed by its own mark, a null row has none."""
    owners, buckets = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for mark, parts in ((1, hosts), (2, paths)):
        rows = [i for i, part in enumerate(parts) if part]
        if not rows:
            continue
        framed = [f"{chr(mark)}{parts[i]}{chr(mark)}" for i in rows]
        codes = np.frombuffer("".join(framed).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        owner = np.repeat(np.array(rows, dtype=np.int64), [len(x) for x in framed])
        for size in GRAMS:
            n = len(codes) - size + 1
            if n <= 0:
                continue
            h = np.full(n, mark * 16 + size, dtype=np.uint64)
            for i in range(size):
                h = mix64(h * np.uint64(31) + codes[i:n + i])
            inside = owner[:n] == owner[size - 1:]
            owners.append(owner[:n][inside])
            buckets.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside])
    both = np.unique(np.concatenate(owners) << BUCKET_BITS | np.concatenate(buckets))
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def _logits(weights: np.ndarray, bias: float, owner: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
    """Features are scaled by their number."""
    total = np.bincount(owner, weights=weights[bucket], minlength=rows)
    return total / np.sqrt(np.maximum(1, np.bincount(owner, minlength=rows))) + bias


def train(table: list[tuple[str, int]] | None = None, steps: int = 300, rate: float = 0.5, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """(weights per bucket, bias) by gradient descent on the mean log loss, both labels weighing the same."""
    table = labelled_urls() if table is None else table
    hosts, paths = zip(*[_parts(url) for url, _ in table], strict=True)
    owner, bucket = grams(list(hosts), list(paths))
    y = np.array([label for _, label in table], dtype=float)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    scale = 1.0 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(y))))
    w, bias, memory, bias_memory = np.zeros(1 << BUCKET_BITS), 0.0, np.full(1 << BUCKET_BITS, 1e-8), 1e-8
    for _ in range(steps):
        error = (sigmoid(_logits(w, bias, owner, bucket, len(y))) - y) * share
        grad = np.bincount(bucket, weights=(error * scale)[owner], minlength=len(w)) + decay * w / len(y)
        memory += grad * grad
        w -= rate * grad / np.sqrt(memory)
        step = error.sum()
        bias_memory += step * step
        bias -= rate * step / np.sqrt(bias_memory)
    return w, bias


def probability(weights: np.ndarray, bias: float, host: Column, path: Column) -> Column:
    """Of a block; null for a null host, 0 for a URL without n-grams."""
    used = np.flatnonzero(weights)
    values = weights[used]

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        w = np.zeros(1 << BUCKET_BITS)
        w[used] = values
        for hosts, paths in batches:
            owner, bucket = grams(hosts.to_pylist(), paths.to_pylist())
            p = sigmoid(_logits(w, bias, owner, bucket, len(hosts)))
            p[np.bincount(owner, minlength=len(hosts)) == 0] = 0.0
            yield pa.array(p, type=pa.float64(), mask=np.asarray(hosts.is_null()))

    return run(host, path)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, probability); probability of a block where no rule fits, else null."""
    weights, bias = train()
    parted = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    ruled = parted.withColumns({"rule": rule, "verdict": verdict})
    # Only URLs without a rule are scored.
    scored = ruled.withColumn("probability", probability(weights, bias, F.when(F.col("rule").isNull(), F.col("host")), F.col("path")))
    learned = F.when(F.col("probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "probability")
