"""Secret scans by grammar inference.

Each credential format is learned from labelled examples as a probabilistic automaton (see ``automata``), and so is
ordinary text from labelled words. Every candidate, that is every run of at least ``LEAST`` credential characters and
every part of it between delimiters, is scored under all of them; of candidates that overlap the likeliest is reported. A candidate is a secret of format f if f is the likeliest of all automata including that of
ordinary words, and if its likelihood per character is no lower than nearly all held-out examples of f reach. The second
condition rejects what merely resembles f more than words do, such as long numbers.

Symbols are the printable ASCII characters. The examples are generated from public format descriptions with a fixed seed;
``train`` accepts other labelled rows instead. Hexadecimal digits alone are as often a commit or a checksum, which no
grammar tells apart, so they count only after a word such as ``key`` or ``token`` (``NAMED``). A private key is judged by
its first line, whose blanks are read as ``_``, and reaches to its last one.

Cases. Null, empty and candidate-free texts have no findings. A null ``doc_id`` is kept as null. Repeated rows report the
same findings each. Runs of any length are scored whole. A part of base64 that
lies between other random text is not a secret. A candidate of equal likelihood under two formats gets the first
by name. An empty table gives an empty result. Other columns are not read; ``redact`` returns them untouched and only
replaces the found characters by ``[SECRET]`` (and, where the table has ``n_chars``, updates it).
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.automata import Automaton
from corpusflow.llm.text import slices

LEAST = 16
EXAMPLES = 1000
HELD_OUT = 200
#: Share of held-out examples of a format that may fall under its limit, and a margin in nats per character.
MISSED = 0.005
MARGIN = 0.15
#: Nats per character by which a format must at least be likelier than symbols that are all equally likely.
GAIN = 0.1
FIRST, SYMBOLS = 33, 94
MARK = "[SECRET]"
PRIVATE = "private_key"

_candidate = re.compile(r"(?<![^\W_])[A-Za-z0-9_+/=\-.]{%d,}" % LEAST)
_word = re.compile(r"[^\W\d_]")
_breaks = re.compile(r"[=/.+\-]+")
_private = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_body, _last = re.compile(r"[A-Za-z0-9+/=:,.\\\s-]*?(?=-----END )|[A-Za-z0-9+/=\\\s]*"), re.compile(r"-----END [A-Z0-9 ]{0,60}-----")
#: What hexadecimal digits must follow within three words, and what they must not follow at once.
NAMED = re.compile(r"(?i)(key|secret|token|passw|pwd|auth|cred|bearer|access|session|salt|private)[^\W_]*([\W_]+[^\W_]+){0,2}[\W_]*$")
UNNAMED = re.compile(r"(?i)(commit|sha[-_]?\d*|md5|checksum|digest|etag|revision|rev|blob|tree|hash|integrity|fingerprint)[\W_]*$")
_digest = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9])")
_before, _after = re.compile(r"[A-Za-z0-9+/]*$"), re.compile(r"[A-Za-z0-9+/]*")
_hex, _lower = "0123456789abcdef", string.ascii_lowercase
_rates = [8, 1.5, 3, 4.5, 13, 2, 2.2, 4.5, 7, 0.3, 1, 4.5, 2.7, 7.5, 6, 2, 0.3, 6.5, 6.5, 8, 3.5, 1, 1.7, 0.2, 1.2, 0.6]
_alnum = string.ascii_letters + string.digits
_url = _alnum + "-_"


def examples(count: int, seed: int = 7) -> dict[str, list[str]]:
    """Labelled strings by format, from public descriptions of the formats; ``word`` is ordinary text."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    syllables = [a + b + c for a in "bcdfghlmnprst" for b in "aeiou" for c in ("", "n", "r", "s", "ng", "tion", "th")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(3, 9)))

    # lengths without memory, so that one state can stand for all symbols of a part of any length
    tail = lambda mean: min(120, int(rng.expovariate(1 / mean)))

    def ordinary() -> str:
        kind = rng.random()
        if kind < 0.45:
            # syllables, or letters at the rates of European languages: words of unknown languages resemble the latter
            w = word() + word() if kind < 0.2 else "".join(rng.choices(_lower, _rates, k=rng.randint(LEAST, 36)))
            return (w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w) + rng.choice(["", "", ".", "..."])
        if kind < 0.6:
            return rng.choice("-_/.").join(word() for _ in range(rng.randint(2, 5)))
        if kind < 0.8:
            return f"{word()}.{pick(string.digits, 2)}"
        if kind < 0.9:
            return pick("=-_.+", 1) * rng.randint(LEAST, 80)
        return pick(string.digits, rng.randint(LEAST, 24))

    makers = {
        "aws_access_key": lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16),
        "github_token": lambda: rng.choice(["ghp_", "gho_", "ghs_", "ghu_", "ghr_"]) + pick(_alnum, 36),
        "google_api_key": lambda: "AIza" + pick(_url, 35),
        "slack_token": lambda: rng.choice(["xoxb-", "xoxp-", "xoxa-"]) + pick(string.digits, 12) + "-" + pick(string.digits, 12) + "-" + pick(_alnum, 24),
        "stripe_key": lambda: rng.choice(["sk_live_", "rk_live_", "sk_test_"]) + pick(_alnum, 24),
        "api_key_sk": lambda: "sk-" + pick(_alnum, 48),
        "npm_token": lambda: "npm_" + pick(_alnum, 36),
        "gitlab_token": lambda: "glpat-" + pick(_url, 20),
        "jwt": lambda: "eyJ" + pick(_url, rng.randint(30, 60)) + ".eyJ" + pick(_url, rng.randint(40, 90)) + "." + pick(_url, 43),
        "hex_32": lambda: pick(_hex, 32),
        "hex_40": lambda: pick(_hex, 40),
        "hex_40_upper": lambda: pick(_hex.upper(), 40),
        "hex_64": lambda: pick(_hex, 64),
        "base64_40": lambda: pick(_alnum + "+/", 40),
        "api_key_dashed": lambda: rng.choice(["sk-proj-", "sk-ant-", "sk-or-", "sk-svcacct-"]) + pick(_url, 24 + tail(30)) + pick(_alnum, 1),
        "private_key": lambda: f"-----BEGIN_{rng.choice(['', 'RSA_', 'EC_', 'DSA_', 'OPENSSH_', 'ENCRYPTED_', 'PGP_'])}PRIVATE_KEY{rng.choice(['', '', '_BLOCK'])}-----",
    }
    out = {"word": [ordinary() for _ in range(4 * count)]}
    for name, make in makers.items():
        out[name] = [make() for _ in range(count)]
    return out


def _symbols(text: str) -> list[int]:
    return [ord(c) - FIRST for c in text]


@dataclass
class Scanner:
    names: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    limits: list[float]
    #: The length of the longest example; parts of a run are scored up to it, see ``candidates``.
    reach: int

    def likelihoods(self, texts: list[str], lengths: list[list[int]] | None = None) -> np.ndarray:
        """Log likelihood per symbol, the end counted as one (automata x texts), all texts in step; with ``lengths``, of
        the beginnings of each text that have these lengths (automata x all of them)."""
        length = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        codes = np.zeros((len(texts), length.max(initial=0)), dtype=np.int32)
        for row, i in enumerate(order):
            codes[row, : length[i]] = np.frombuffer(texts[i].encode("ascii"), dtype=np.uint8).astype(np.int32) - FIRST
        live = np.searchsorted(-length[order], -np.arange(codes.shape[1]), side="left")
        row_of = np.empty(len(texts), dtype=np.int64)
        row_of[order] = np.arange(len(texts))
        rows = row_of if lengths is None else np.repeat(row_of, [len(x) for x in lengths])
        stops = length if lengths is None else np.array([n for x in lengths for n in x], dtype=np.int64)
        by = np.argsort(stops, kind="stable")
        cuts = np.searchsorted(stops[by], np.arange(codes.shape[1] + 2))
        out = np.zeros((len(self.names), len(stops)))
        for k, (to, log, end) in enumerate(self.tables):
            state, total = np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts))
            out[k, by[: cuts[1]]] = end[0]
            for j, n in enumerate(live):
                total[:n] += log[state[:n], codes[:n, j]]
                state[:n] = to[state[:n], codes[:n, j]]
                at = by[cuts[j + 1] : cuts[j + 2]]
                out[k, at] = total[rows[at]] + end[state[rows[at]]]
        return out / (stops + 1)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """start, length, format, likelihood of each secret."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """start, length, format, likelihood of the secrets of each text, in order."""
        asked = [(i, a, stops) for i, text in enumerate(texts) for a, stops in candidates(text, self.reach)]
        keys = [self.private_keys(text) for text in texts]
        asked.sort(key=lambda x: x[2][-1])
        # where a format has / or +, a part between two of them may be a path or a piece of a longer random text
        alphabets = [{chr(c + FIRST) for c in np.flatnonzero((to < len(to) - 1).any(axis=0))} for to, _, _ in self.tables]
        mixed = [bool(x & set("/+")) for x in alphabets]
        hits: list[list[tuple[float, int, int, int, float]]] = [[] for _ in texts]
        start = 0
        while start < len(asked):
            stop = start + 1
            while stop < len(asked) and stop - start < 4096 and asked[stop][2][-1] * (stop - start) < 1 << 20:
                stop += 1
            part = asked[start:stop]
            scores = self.likelihoods([texts[i][a : a + s[-1]] for i, a, s in part], [s for _, _, s in part])
            best = scores.argmax(axis=0)
            spans = [(i, a, n) for i, a, s in part for n in s]
            value = scores[best, np.arange(len(best))]
            for x in np.flatnonzero(value >= np.array(self.limits)[best]):
                (i, a, n), k, v = spans[x], int(best[x]), float(value[x])
                fits = alphabets[k].issuperset(texts[i][a : a + n]) and (not mixed[k] or _alone(texts[i], a, a + n))
                if fits and self.names[k].startswith("hex_"):
                    context = texts[i][max(0, a - 48) : a]
                    fits = bool(NAMED.search(context)) and not UNNAMED.search(context)
                if fits and self.names[k] not in ("word", PRIVATE):
                    # what the span gains over symbols that are all equally likely, so that junk at its ends loses
                    hits[i].append(((v + math.log(SYMBOLS + 1)) * (n + 1), a, n, k, v))
            start = stop
        out = []
        for text, found, whole in zip(texts, hits, keys):
            taken: list[tuple[int, int, str, float]] = list(whole)
            for _, a, n, k, v in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                # a rare symbol near an end makes a part gain more than the whole, so it is widened to the whole
                a, n, v = max(((b, m, w) for _, b, m, f, w in found if f == k and not mixed[k] and b <= a and b + m >= a + n and alphabets[k].issuperset(text[b : b + m])), key=lambda x: x[1], default=(a, n, v))
                if all(a + n <= b or b + m <= a for b, m, _, _ in taken):
                    taken.append((a, n, self.names[k], v))
            out.append(sorted(taken))
        return out

    def private_keys(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """The private keys of a text whose first lines are likely enough: to their last line, or as far as base64 goes."""
        found = list(_private.finditer(text or "")) if PRIVATE in self.names else []
        if not found:
            return []
        k, out, after = self.names.index(PRIVATE), [], 0
        for m, v in zip(found, self.likelihoods([m[0].replace(" ", "_") for m in found])[k]):
            if v >= self.limits[k] and m.start() >= after:
                body = _body.match(text, m.end()).end()
                last = _last.match(text, body)
                after = last.end() if last else max(m.end(), m.end() + len(text[m.end() : body].rstrip()))
                out.append((m.start(), after - m.start(), PRIVATE, float(v)))
        return out


def _random(text: str) -> bool:
    """Whether text changes between upper case, lower case and digits as often as random text does and words do not."""
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in text if c.isalnum()]
    return len(kinds) >= 8 and sum(x != y for x, y in zip(kinds, kinds[1:])) > 0.4 * (len(kinds) - 1)


def _alone(text: str, a: int, b: int) -> bool:
    """Whether a span looks random, is no path to a checksum, and what adjoins it does not look random."""
    return _random(text[a:b]) and not _digest.search(text[a:b]) and not _random(_before.search(text[max(0, a - 32) : a])[0]) and not _random(_after.match(text[b : b + 32])[0])


def candidates(text: str | None, reach: int) -> list[tuple[int, list[int]]]:
    """Starts of possible secrets and, for each, their possible lengths in ascending order.

    A secret lies within a run of credential characters. It starts where the run does or after one of ``= / . + -``, and
    ends where the run does or before one of them; no letter or digit adjoins it. Where ``@`` follows, it is a user's name
    in an address unless it starts after one of ``/ : =``. Spans of up to ``reach`` characters are candidates; of longer
    ones, the whole run and what lies between two of ``= / +``.
    """
    out = []
    for m in _candidate.finditer(text or ""):
        a, b = m.span()
        run = text[a:b]
        # a secret may itself start or end with one of several delimiters in a row
        breaks = [x.span() for x in _breaks.finditer(run)]
        starts = sorted({0, *(p for x, y in breaks for p in (x + 1, y) if p < len(run))})
        ends = sorted({p for x, y in breaks for p in (x, y - 1)})
        next_text = text[b : b + 1]
        whole = len(run.rstrip(".")) if not (next_text == "@" or _word.match(next_text)) else -1
        if whole > 0:
            ends = sorted({*ends, whole, len(run)})
        hard = [x.start() for x in re.finditer(r"[=/+]", run)] + [len(run)]
        for s in starts:
            lengths = {e - s for e in ends[bisect_left(ends, s + LEAST) : bisect_right(ends, s + reach)]}
            if s == 0 and whole >= LEAST:
                lengths.add(whole)
            if s == 0 or run[s - 1] in "=/+":
                e = hard[bisect_left(hard, s)]
                lengths |= {e - s} if e - s >= LEAST and (e < len(run) or whole > 0) else set()
            if next_text == "@" and len(run) - s >= LEAST and (a + s and text[a + s - 1] in "/:="):
                lengths.add(len(run) - s)
            if lengths:
                out.append((a + s, sorted(lengths)))
    return out


@cache
def _default() -> Scanner:
    return train(examples(EXAMPLES), examples(HELD_OUT, seed=8))


def train(labelled: dict[str, list[str]] | None = None, held_out: dict[str, list[str]] | None = None) -> Scanner:
    """Infer one automaton per format; without arguments from ``examples``, once per process."""
    if labelled is None and held_out is None:
        return _default()
    labelled = labelled or examples(EXAMPLES)
    held_out = held_out or examples(HELD_OUT, seed=8)
    names = sorted(labelled)
    scanner = Scanner(names, [Automaton.infer([_symbols(x) for x in labelled[n]]).tables(SYMBOLS) for n in names], [-np.inf] * len(names), max((len(x) for n in names for x in labelled[n] if n != "word"), default=0))
    for k, n in enumerate(names):
        scores = scanner.likelihoods(held_out[n])[k] if held_out.get(n) else scanner.likelihoods(labelled[n])[k]
        scanner.limits[k] = max(float(np.quantile(scores, MISSED)) - MARGIN, GAIN - math.log(SYMBOLS + 1))
    return scanner


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def findings(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per secret: doc_id, position (from 0, in characters), length, format, likelihood per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = scanner.scan_all(part.column("text").to_pylist())
                hits = [(i, *hit) for i, of_text in enumerate(found) for hit in of_text]
                cols = list(zip(*hits)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())],
                    names=["doc_id", "position", "length", "format", "likelihood"],
                )

    return _texts(docs).mapInArrow(run, "doc_id bigint, position int, length int, format string, likelihood double")


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``."""

    names = [f.name for f in docs.schema.fields]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for i, found in enumerate(scanner.scan_all(texts)):
                    for a, n, *_ in reversed(found):
                        texts[i] = texts[i][:a] + MARK + texts[i][a + n :]
                columns = list(part.columns)
                columns[names.index("text")] = pa.array(texts, part.column("text").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
