"""Secret scan with a random forest that removes false positives.

Candidates are values assigned to credential names (by = or :), well-known token shapes, and runs of 16 or more
key characters with digits or mixed case. Features: length, shares of character classes, transitions between
classes, likelihood of the character pairs under the corpus's own pair counts (all documents), coverage by
dictionary words (those in most documents, and a plain list of words of code), the path, and the words beside it. Trees are trained in parallel, each on a bootstrap
sample and random features, from labelled findings: rows of (value, left, right, path, label). The default
findings are made by rule from a seed: keys of many shapes in code, configuration and prose, against
digests, identifiers, numbers, names, paths and placeholders. Other findings can be passed in.

Cases: null and empty texts have no findings; a null path counts as empty; of overlapping candidates the
one that begins first, then the longer, is kept; repeated rows give equal findings each; an empty table
gives an empty table. redacted() passes columns through inside a struct.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import random
import re
import string
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import as_struct, quoted, stored
from .text import mix, prefix_hash, range_hash, slices, utf8

THRESHOLD = 0.5
TREES, DEPTH, FINDINGS, CUTS = 48, 9, 6000, 16
MASK = "[SECRET]"
CREDENTIAL = r"(?:api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|client[_-]?secret|credential|passw(?:or)?d|private[_-]?key|pwd|secret|token)"
ASSIGNED = re.compile(rf"(?i){CREDENTIAL}[\w-]*[\"']?\s*(?:=|:=|:|=>)\s*[\"']?(?P<v>[^\s\"',;]{{6,}})")
SHAPED = re.compile(r"(?P<v>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bxox[abprs]-[A-Za-z0-9-]{20,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{4,})")
RUN = re.compile(r"(?P<v>[A-Za-z0-9+/_=-]{16,})")
#: Words of code and configuration, which keys do not contain (fixed, plain list); the corpus's own words are added to them.
DICTIONARY = """
about access account add admin after all and api app args array async auth base block body bool build byte cache call case change channel char check class
client close code column commit config connect console content context count create current data database date debug default delete demo dev dict digest
document domain dummy edit email enable end entry error event example export false field file find first float folder format from function get group
handle hash header hello help here home host html http image import index info init input insert int item java json key label last length level
library line link list load local lock log login main make map max message meta method min mock mode model module name new next node null number object
offset open option order output page parse path placeholder port post print private process product project property public query read record remove
request reset response result return root row run sample save schema script search secret select server service session set size source start state
status string style sub table tag target temp test text that the this time title token total true type update url use user util value version view
void web with word world write your
""".split()
#: Words of the corpus: so many of those that stand in most documents, in LEAST_DOCUMENTS at least, of so many letters.
WORDS, LEAST_DOCUMENTS, LETTERS = 4000, 3, (4, 20)
#: Words that a task holds before it sends their counts on.
HELD = 200_000
_KIND = np.full(256, 3, dtype=np.int64)
for _span, _k in ((string.digits, 0), (string.ascii_lowercase, 1), (string.ascii_uppercase, 2)):
    _KIND[[ord(c) for c in _span]] = _k
_KEYS = np.zeros(256, dtype=bool)
_KEYS[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NAMES = re.compile(rf"(?i){CREDENTIAL}")
#: A credential name holds one of these, a token of a known shape one of those.
_ROOTS = ("api", "access", "auth", "bearer", "client", "credential", "passw", "private", "pwd", "secret", "token")
_HEADS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ")
_DIGESTS = re.compile(r"(?i)\b(?:sha\d*|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|integrity|id|number|card|version|build)\b")
_FAKE = re.compile(r"(?i)example|sample|dummy|fake|your|placeholder|change_?me|test|xxx|redacted|<|\$\{")
_TESTS = re.compile(r"(?i)test|example|mock|sample|doc|fixture|lock")
_CODE = re.compile(r"(?i)\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|py|js|ts|go|java|rb|sh|tf)$")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) without overlaps."""
    found = []
    # letters that match others when case is ignored are folded; a pattern runs only where one of its parts is there
    folded = text.casefold() if text.isascii() else text.casefold().replace("\u0131", "i").replace("\u0307", "")
    if ("=" in text or ":" in text) and any(x in folded for x in _ROOTS):
        found += [(m.start("v"), m.end("v"), "assigned") for m in ASSIGNED.finditer(text)]
    if any(x in text for x in _HEADS):
        found += [(m.start("v"), m.end("v"), "shaped") for m in SHAPED.finditer(text)]
    for m in RUN.finditer(text):
        v = m["v"]
        if any(c.isdigit() for c in v) or (any(c.isupper() for c in v[1:]) and any(c.islower() for c in v)):
            found.append((m.start(), m.end(), "run"))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def beside(text: str, start: int, stop: int) -> tuple[str, str]:
    """Up to four words before and two after, with what touches the value."""
    return " ".join(text[max(0, start - 80) : start].rsplit(None, 4)[-4:]), " ".join(text[stop : stop + 40].split(None, 2)[:2])


class Pairs:
    """What the corpus says of a value: likelihood of its character pairs, and the share of it that words cover."""

    def __init__(self, counts: dict[int, int], words: list[str] | None = None) -> None:
        table = np.full(256 * 256, 0.1)
        for k, n in counts.items():
            table[k] += n
        table = table.reshape(256, 256)
        self.log = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
        self.words = sorted({w for w in [*DICTIONARY, *(words or [])] if len(w) >= LETTERS[0]})
        self._finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}

    def mean(self, value: bytes) -> float:
        a = np.frombuffer(value, dtype=np.uint8)
        return float(self.log[a[:-1], a[1:]].mean()) if len(a) > 1 else 0.0

    def covered(self, value: str) -> float:
        """The share of characters that lie in a word of the dictionary; all words are looked for at once."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for w in self.words:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        low, inside = value.lower(), np.zeros(len(value.lower()), dtype=bool)
        for end, n in self._finder.iter(low):
            inside[end - n + 1 : end + 1] = True
        return float(inside.mean()) if len(low) else 0.0


def _letter_runs(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of the runs of ASCII letters of LETTERS letters, between other bytes or the bounds of texts."""
    low = _LOWER[part]
    other = np.flatnonzero((low < 97) | (low > 122))
    starts, stops = np.sort(np.concatenate([other + 1, own[:-1]]), kind="stable"), np.sort(np.concatenate([other, own[1:]]), kind="stable")
    fits = (stops - starts >= LETTERS[0]) & (stops - starts <= LETTERS[1])
    starts, stops = starts[fits], stops[fits]
    return starts, stops, np.searchsorted(own, starts, side="right") - 1


def corpus_counts(docs: DataFrame) -> DataFrame:
    """pair, word, n: counts of byte pairs inside all whole texts (word is null), and in how many documents each word stands (pair is null).

    Words are runs of ASCII letters, case ignored. One pass and one aggregation with map-side partials.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(65536, dtype=np.int64), {}
        sent = lambda w: pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.int64())], ["pair", "word", "n"])
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = raw[offsets[lo] : offsets[hi]]
                wide = part.astype(np.int64)
                pairs = wide[:-1] * 256 + wide[1:]
                inside = np.ones(len(pairs), dtype=bool)
                border = own[1:-1]
                inside[border[(border > 0) & (border < len(part))] - 1] = False
                total += np.bincount(pairs[inside], minlength=65536)
                start, stop, row = _letter_runs(part, own)
                if len(start):
                    low = _LOWER[part]
                    name = range_hash(prefix_hash(low), start, stop)
                    # once for each document that has it
                    _, first = np.unique(name ^ mix(row.astype(np.uint64)), return_index=True)
                    _, at, n = np.unique(name[first], return_index=True, return_counts=True)
                    text = low.tobytes()
                    for i, k in zip(first[at].tolist(), n.tolist(), strict=True):
                        w = text[start[i] : stop[i]].decode()
                        words[w] = words.get(w, 0) + k
                    if len(words) > HELD:
                        yield sent(words)
                        words = {}
        if words:
            yield sent(words)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.nulls(len(at), pa.string()), pa.array(total[at], pa.int64())], ["pair", "word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "pair long, word string, n long").groupBy("pair", "word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame) -> dict[int, int]:
    """Counts of byte pairs inside all whole texts; at most 65,536 rows come to the driver."""
    return {r["pair"]: r["n"] for r in corpus_counts(docs).where("pair IS NOT NULL").collect()}


def learned(docs: DataFrame) -> Pairs:
    """Pairs and words of the corpus; at most 65,536 + WORDS rows come to the driver."""
    counts = stored(corpus_counts(docs), "counts")
    pairs = {r["pair"]: r["n"] for r in counts.where("pair IS NOT NULL").select("pair", "n").collect()}
    words = counts.where((F.col("word").isNotNull()) & (F.col("n") >= LEAST_DOCUMENTS)).orderBy(F.desc("n"), "word").limit(WORDS)
    return Pairs(pairs, [r["word"] for r in words.select("word").collect()])


def features(value: str, left: str, right: str, path: str, pairs: Pairs) -> list[float]:
    raw = value.encode()
    kind = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    n = len(kind)
    share = np.bincount(kind, minlength=4) / n
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8))
    counts = counts[counts > 0]
    same = max(len(m.group()) for m in re.finditer(r"(.)\1*", value, re.S))
    letters = max((len(m) for m in re.findall(r"[A-Za-z]+", value)), default=0)
    p = counts / n
    before, after = left[-1:], right[:1]
    return [
        float(n), *share.tolist(), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, float(-(p * np.log2(p)).sum()), len(counts) / n, same / n, letters / n,
        pairs.mean(raw), pairs.covered(value), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(value.isdigit()), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(before in "=:\"'" and before != ""), float(before in "\"'" and after in "\"'" and before != ""), float(bool(_NAMES.search(left))), float(bool(_DIGESTS.search(left))), float(bool(_FAKE.search(value))), float(bool(_FAKE.search(left + right))),
        float(bool(_TESTS.search(path))), float(bool(_CODE.search(path))), float(path.count("/")), float(bool(SHAPED.fullmatch(value))),
    ]


def made_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings by rule: (value, left, right, path, label)."""
    r = random.Random(seed)
    pick, text = r.choice, lambda letters, n: "".join(r.choices(letters, k=n))
    b64 = lambda n: base64.b64encode(r.randbytes(n)).decode()
    word = lambda: text("aeiou", 1).join(text("bcdfghlmnprst", 1) for _ in range(r.randint(2, 5)))
    prose = lambda: "".join(word() + pick((" ", " ", ", ", ". ")) for _ in range(r.randint(0, 4)))
    keys = [
        lambda: r.randbytes(pick((16, 20, 20, 24, 32))).hex(), lambda: r.randbytes(20).hex().upper(), lambda: b64(pick((18, 24, 30, 33, 48))), lambda: text(string.ascii_letters + string.digits, r.randint(20, 44)),
        lambda: "AKIA" + text(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + text(string.ascii_letters + string.digits, 36), lambda: f"eyJ{text(string.ascii_letters, 17)}.{text(string.ascii_letters + string.digits, 40)}.{text(string.ascii_letters + string.digits, 43)}",
    ]
    others = [
        lambda: (r.randbytes(20).hex(), pick(("commit ", "revision: ", "sha1 = ", "checksum: ", "digest ", "etag: ")), ""), lambda: (r.randbytes(pick((16, 32))).hex(), pick(("md5: ", "sha256:", "hash = ", "integrity ")), ""),
        lambda: (str(uuid.UUID(int=r.getrandbits(128))), pick(("id: ", "uuid = ", "guid=", word() + " ")), ""), lambda: (text(string.digits, r.randint(16, 22)), pick((word() + " ", "number ", "id=", "card: ")), " " + word()),
        lambda: ("_".join(pick(DICTIONARY) for _ in range(r.randint(3, 6))) + pick(("", "2", "_v1")), pick(("def ", "self.", "from ", "token = ", "key: ")), ""), lambda: ("".join(pick(DICTIONARY).title() for _ in range(r.randint(3, 6))), pick(("class ", "new ", "import ")), ""),
        lambda: ("/".join(pick(DICTIONARY) for _ in range(4)) + "/" + text(string.digits, 2), pick(("open ", "path = ", "")), ""), lambda: (pick(("your_api_key_here", "changeme123456789", "example-token-123", "xxxxxxxxxxxxxxxxxxxx1", "INSERT_TOKEN_HERE_1", "test_secret_value_1")), pick(('token = "', 'api_key: "', "password=")), '"'),
        lambda: (word() + word() + word() + word() + text(string.digits, 1), word() + " ", " " + word()), lambda: (text(pick("0ab="), r.randint(16, 30)) + "1", word() + " ", ""), lambda: ((word() + word() + word() + word()).upper() + "2", word() + " ", " " + word()),
        lambda: (word() + word(), pick(("password: ", "token: ", "secret = ")), " " + word()),
    ]
    paths = ("", "", "", "src0", "app/config.yml", "deploy/.env", "src/main.py", "settings.json", "docs/readme.md", "web/client.js")
    out = []
    for i in range(n):
        if i % 2:
            name = pick(("token", "TOKEN", "api_key", "API_KEY", "secret", "password", "access_key", "auth_token", "Authorization: Bearer", "client_secret", "private_key"))
            quote = pick(('"', '"', "'", ""))
            left = f"{word()} {name}{pick((' = ', '=', ': ', ' => ')) if ':' not in name else ' '}{quote}"
            # some stand alone in prose
            left, quote = (left, quote) if r.random() < 0.85 else (word() + " ", "")
            out.append((pick(keys)(), prose() + left, quote + pick((" ", "")) + word(), pick(paths), 1))
        else:
            v, left, right = pick(others)()
            out.append((v, prose() + left, right, pick(paths) if r.random() < 0.7 else "tests/" + pick(paths), 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
    """One tree as arrays: feature (-1: leaf), cut, left child, right child, value."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, len(y), len(y))
    x, y = x[rows], y[rows]
    nodes: list[list[float]] = []
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)

    def split(at: np.ndarray, depth: int) -> int:
        me, mean = len(nodes), y[at].mean()
        nodes.append([-1, 0, 0, 0, mean])
        if depth == DEPTH or len(at) < 4 or mean in (0, 1):
            return me
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[at, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]))
            under = v[:, None] <= cuts[None, :]
            n = under.sum(0)
            ones = (under * y[at][:, None]).sum(0)
            ok = (n > 0) & (n < len(at))
            if ok.any():
                m, all_ones = len(at) - n[ok], y[at].sum()
                score = ones[ok] ** 2 / n[ok] + (all_ones - ones[ok]) ** 2 / m - all_ones**2 / len(at)
                i = int(np.argmax(score))
                if score[i] > best[0] + 1e-12:
                    best = (float(score[i]), int(f), float(cuts[ok][i]))
        if best[1] < 0:
            return me
        low = x[at, best[1]] <= best[2]
        nodes[me][:4] = [best[1], best[2], split(at[low], depth + 1), split(at[~low], depth + 1)]
        return me

    split(np.arange(len(y)), 0)
    table = np.array(nodes)
    return [table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]]


class Forest:
    def __init__(self, trees: list[list[np.ndarray]], pairs: Pairs) -> None:
        self.trees, self.pairs = trees, pairs

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = feature[at]
                below = np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, below)
            total += value[at]
        return total / max(1, len(self.trees))

    def findings(self, text: str, path: str) -> list[tuple[int, int, str, float]]:
        """(start, stop, kind, score) of the candidates of one text."""
        found = candidates(text)
        if not found:
            return []
        x = np.array([features(text[a:b], *beside(text, a, b), path, self.pairs) for a, b, _ in found])
        return [(*c, float(s)) for c, s in zip(found, self(x), strict=True)]


def fit(docs: DataFrame, labelled: list[tuple[str, str, str, str, int]] | None = None, trees: int = TREES) -> Forest:
    """A forest on labelled findings, by default made_findings(); trees grow in parallel."""
    spark, pairs = docs.sparkSession, learned(docs)
    rows = made_findings() if labelled is None else labelled
    x, y = np.array([features(*r[:4], pairs) for r in rows]), np.array([r[4] for r in rows], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tree": [pickle.dumps(_grow(x, y, int(i))) for i in b["id"]]})

    grown = spark.range(trees, numPartitions=min(trees, 16)).mapInPandas(run, "id long, tree binary").orderBy("id").collect() if len(rows) else []
    return Forest([pickle.loads(bytes(r["tree"])) for r in grown], pairs)


def _worth_reading(column: pa.Array) -> np.ndarray:
    """Texts with a run of 16 key characters or an assignment sign; the others have no candidates."""
    raw, offsets = utf8(column)
    out = np.zeros(len(column), dtype=bool)
    for lo, hi in slices(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        # runs end at other characters and at the bounds of texts, which lie back to back
        other = np.flatnonzero(~_KEYS[part])
        starts, stops = np.sort(np.concatenate([other + 1, own[:-1]]), kind="stable"), np.sort(np.concatenate([other, own[1:]]), kind="stable")
        signs = np.flatnonzero((part == ord("=")) | (part == ord(":")) | (part == ord(".")) & (np.append(part[1:], 0) > 32))
        for at in (starts[stops - starts >= 16], signs):
            out[lo + np.searchsorted(own, at, side="right") - 1] = True
    return out


FOUND = "doc_id long, start long, stop long, kind string, masked string, value_sha256 string, score double, is_secret boolean"


def scan(docs: DataFrame, model: Forest, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """All candidates of all whole texts with the forest's verdict; offsets in characters, values masked."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in np.flatnonzero(_worth_reading(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py() or ""
                for a, b, kind, score in model.findings(text, batch.column(2)[i].as_py() or ""):
                    v = text[a:b]
                    out.append((batch.column(0)[i].as_py(), a, b, kind, v[:4] + "*" * (len(v) - 4), hashlib.sha256(v.encode()).hexdigest(), score, score >= threshold))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 8, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), where.alias("path")).mapInArrow(run, FOUND)


def redacted(docs: DataFrame, model: Forest, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs' own columns, secrets in the text replaced by MASK; n_chars follows where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, str] = {}
            for i in np.flatnonzero(_worth_reading(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py() or ""
                spans = [(a, b) for a, b, _, score in model.findings(text, batch.column(2)[i].as_py() or "") if score >= threshold]
                if spans:
                    at, out = 0, []
                    for a, b in spans:
                        out += [text[at:a], MASK]
                        at = b
                    texts[i] = "".join([*out, text[at:]])
            new = pa.array([texts.get(i) for i in range(len(batch))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), new], ["row", "new"])

    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    both = docs.select(as_struct(docs).alias("row"), F.col("text").cast("string").alias("text"), where.alias("path"))
    done = both.mapInArrow(run, both.select("row").schema.add("new", "string"))
    text = F.coalesce("new", F.col("row.text"))
    out = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*(out.get(c, F.col("row." + quoted(c))).alias(c) for c in docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with score and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs, fit(docs))
