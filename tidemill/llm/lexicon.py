"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are compiled, with their ids as output, into an automaton that shares prefixes and suffixes. Counts on its
arcs add up to a word's number, and the number finds the word's ids in one pool. The file is shipped once to every executor
and memory-mapped; a batch's distinct words walk it together, a byte a step. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, shared_dir, stored, table

#: Words that are compiled: bounds the file, the driver's share of the counts and the time to compile.
LEXICON_WORDS = 50_000
#: Distinct words whose ids a worker keeps.
MEMO = 200_000
#: Bytes of the longest word that is compiled.
LONGEST = 48

# Latin text in which \w, \d and \s of the plain engine agree with \p{L}, \p{N} and white space.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u024f]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Merger:
    """The vocabulary and the exact merges of words, many at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([self.vocab[x] for x in letters], np.int64)
        self.last = np.array([self.vocab[x + end] for x in letters], np.int64)
        pairs = np.array([(self.vocab[a] << 20 | self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]], np.int64)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.pair, self.made, self.rank = pairs[order, 0], pairs[order, 1], order

    def ids(self, found: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty, in UTF-8). Every round merges, in each word that still has one, its lowest-ranked pair."""
        size = np.array([len(w) for w in found], np.int64)
        raw = np.frombuffer(b"".join(found), np.uint8)
        word = np.repeat(np.arange(len(found)), size)
        ids = self.inner[raw]
        ids[np.cumsum(size) - 1] = self.last[raw[np.cumsum(size) - 1]]
        out: list = [None] * len(found)
        none = len(self.rank)
        while len(ids):
            key = ids[:-1] << 20 | ids[1:]
            at = np.minimum(np.searchsorted(self.pair, key), none - 1)
            rank = np.append(np.where((self.pair[at] == key) & (word[:-1] == word[1:]), self.rank[at], none), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            over = least == none
            for k, part in zip(word[first[over]].tolist(), np.split(ids, first[1:]) if over.all() else [ids[a:b] for a, b in zip(first[over], np.append(first[1:], len(ids))[over], strict=True)], strict=True):
                out[k] = part
            length = np.diff(np.append(first, len(ids)))
            hit = (rank == np.repeat(least, length)) & (rank < none)
            # of a run of hits (a letter thrice and more) every second one counts, from the left
            run = np.flatnonzero(hit & np.append(False, hit[:-1]))
            for i in run.tolist():
                hit[i] = not hit[i - 1]
            ids = np.where(hit, self.made[np.append(at, 0)], ids)
            keep = ~np.append(False, hit[:-1]) & np.repeat(~over, length)
            ids, word = ids[keep], word[keep]
        return out


@functools.cache
def splitter(path: str) -> Callable[[str], list[str]]:
    """The words of any text through the library's own normaliser and split, whose Unicode tables decide for unusual letters."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
    split = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
    return lambda text: [w for w, _ in split.pre_tokenize_str(whole.normalizer.normalize_str(text))]


def words(text: str, path: str) -> list[str]:
    """The words of a text as the tokenizer sees them: NFC, lower case letter by letter, white space dropped."""
    if _PLAIN.fullmatch(text):
        return _WORDS.findall(text.lower())
    return splitter(path)(text)


def compile_lexicon(entries: Iterable[tuple[bytes, Iterable[int]]]) -> bytes:
    """The automaton of the words (any order, distinct, not empty) as one file: a header and flat little-endian arrays."""
    entries = sorted(entries, key=lambda e: e[0])
    final, arcs = [False], [{}]  # state -> label -> state
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) of the last word's way

    def close(down_to: int) -> None:
        """Replace finished states by equal ones that are registered: the automaton stays minimal."""
        while len(path) > down_to:
            state, label = path.pop()
            child = arcs[state][label]
            key = (final[child], tuple(arcs[child].items()))
            arcs[state][label] = register.setdefault(key, child)

    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for label in word[common:]:
            final.append(False)
            arcs.append({})
            arcs[state][label] = len(arcs) - 1
            path.append((state, label))
            state = len(arcs) - 1
        final[state] = True
        last = word
    close(0)
    number, order = {0: 0}, [0]
    for state in order:
        for child in arcs[state].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
    count: dict[int, int] = {}

    def below(state: int) -> int:
        if state not in count:
            count[state] = final[state] + sum(below(c) for c in arcs[state].values())
        return count[state]

    key, to, skip = [], [], []
    for state in order:
        before = int(final[state])
        for label, child in sorted(arcs[state].items()):
            key.append(number[state] << 8 | label)
            to.append(number[child])
            skip.append(before)
            before += below(child)
    starts = np.cumsum([0] + [len(ids) for _, ids in entries])
    parts = [np.array(key, "<u4"), np.array(to, "<u4"), np.array(skip, "<u4"), np.array([final[s] for s in order], "<u4"), starts.astype("<u4"), np.array([i for _, ids in entries for i in ids], "<u4")]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped from its file."""

    def __init__(self, path: str) -> None:
        flat = np.memmap(path, "<u4", "r")
        ends = np.cumsum([6, *flat[:6]])
        self.key, self.to, self.skip, self.final, self.starts, self.pool = (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def find(self, found: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those not compiled; all words take their steps together."""
        out = np.full(len(found), -1, np.int64)
        if not len(self.key):
            return out
        size = np.array([len(w) for w in found], np.int64)
        raw, base = np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        state, total, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            want = (state << 8 | raw[base[live] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            live, at = live[ok], at[ok]
            state, total, step = self.to[at].astype(np.int64), total[ok] + self.skip[at], step + 1
            done = size[live] == step
            hit = done & (self.final[state] == 1)
            out[live[hit]] = total[hit]
            live, state, total = live[~done], state[~done], total[~done]
        return out

    def ids(self, number: int) -> np.ndarray:
        return self.pool[self.starts[number] : self.starts[number + 1]]


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """Frequent runs of letters of all texts, counted over every document: those that occur so often that no more than `most` do.

    A histogram of counts on a logarithmic scale, a few thousand rows, gives the bound first. So only the words that are
    taken reach the driver, whatever the number of partitions.
    """
    runs = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where((F.length("w") > 0) & (F.octet_length("w") <= LONGEST))
    counts = stored(runs.groupBy("w").agg(F.count("*").alias("n")).select("w", F.floor(F.log2("n") * 64).cast("int").alias("level")).where("level > 0"), "words")
    left, least = most, None
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = level
    return sorted(r[0] for r in counts.where(F.col("level") >= least).select("w").collect()) if least is not None else []


def ship_lexicon(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of docs and give every executor a copy of its file; returns the file's name."""
    merger = Merger(tokenizer_path)
    found = [w.encode() for w in frequent_words(docs, most) if words(w, tokenizer_path) == [w]]
    data = compile_lexicon(zip(found, merger.ids(found), strict=True))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    # into the shared folder, from which Spark gives every executor a copy; a session takes a name from one path only
    sc = docs.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(docs.sparkSession)}/tidemill/{name}")
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(where, True)
    out.write(bytearray(data))
    out.close()
    sc.addFile(fs.makeQualified(where).toString())
    return name


class Coder:
    """Encodes and decodes texts; keeps the ids (32-bit bytes) and token strings of words it has met."""

    def __init__(self, lexicon_path: str, tokenizer_path: str) -> None:
        self.lexicon, self.merger, self.path = Lexicon(lexicon_path), Merger(tokenizer_path), tokenizer_path
        self.special = re.compile("(" + "|".join(map(re.escape, self.merger.special)) + ")")
        self.memo: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        token = self.merger.token
        raw = [w.encode("utf-8", "replace") for w in new]
        number = self.lexicon.find(raw)
        lacking = np.flatnonzero(number < 0).tolist()
        merged = dict(zip(lacking, self.merger.ids([raw[i] for i in lacking]), strict=True))
        for i, (w, k) in enumerate(zip(new, number.tolist(), strict=True)):
            ids = self.lexicon.ids(k) if k >= 0 else merged[i]
            self.memo[w] = ids.astype("<u4").tobytes()
            self.shown[w] = " ".join(map(token.__getitem__, ids.tolist()))

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit bytes, decoded text) of each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.shown.clear()
        split = [self.pieces(t) for t in texts]
        self.learn(list({w for ws in split for w in ws} - self.memo.keys()))
        return [(b"".join(map(self.memo.__getitem__, ws)), " ".join(map(self.shown.__getitem__, ws))) for ws in split]

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text:
            return words(text, self.path)
        out = []
        for part in self.special.split(text):
            if part in self.merger.special:
                # upper-case key: no word has one, as words are in lower case
                key = "SPECIAL" + part
                self.memo[key] = np.array([self.merger.special[part]], "<u4").tobytes()
                self.shown[key] = part
                out.append(key)
            else:
                out += words(part, self.path)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.merger.token.__getitem__, ids.tolist()))


def encode(docs: DataFrame, digest: Callable[[bytes, str], dict], schema: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every whole text (null: empty) and keep of each what `digest` makes of the ids' bytes and the decoded text.

    schema: of the columns of digest, which follow doc_id. Ids may be null or repeat; an empty table gives no row. An empty
    text has no ids and decodes to an empty text.
    """
    tokenizer_name = tokenizer or "word_bpe_49k.json"
    docs = docs.select("doc_id", "text")
    name = ship_lexicon(docs, public_tokenizers.path(tokenizer_name))

    def work(coder: Coder, rows: dict) -> dict:
        got = [digest(ids, text) for ids, text in coder.encode_batch([t or "" for t in rows["text"]])]
        return {"doc_id": rows["doc_id"]} | {k: [g[k] for g in got] for k in keys}

    keys = [c.split()[0] for c in schema.split(",")]
    return map_slices(docs, work, "doc_id long, " + schema, setup=lambda: Coder(SparkFiles.get(name), public_tokenizers.path(tokenizer_name)))


def op4_fst_bpe(spark, sf_dir):
    """Encode and decode every row of documents; a null text is empty, null and repeated ids give a row each, other columns are ignored."""

    def digest(ids: bytes, text: str) -> dict:
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}

    return encode(table(spark, sf_dir, "documents"), digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
