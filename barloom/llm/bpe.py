"""BPE encoding and decoding by a tokenization automaton compiled from the merges.

Compiling. The automaton reads tokens and accepts exactly the sequences that BPE leaves. It starts with one state that
loops on every base symbol; each merge (u, v), in order, is a gadget on it (`gadgets`):

* T(u), the state that token u leads to, is replaced by a copy without the arc v;
* T(uv) becomes the state T(v) was before that;
* every state that still has an arc u gets an arc uv.

As the last rule is the same for all states, a state is held by the arcs it lost, each with the time of the loss; a token's
arc is there unless it, or the start it was built on at that time, was lost. That is under a million entries for 50,000 merges, built in
one pass, and equal states are one.

Encoding. Composed with the spelling of tokens, the automaton reads symbols (bytes, the last one of a word marked where the
vocabulary marks word ends). A composed state is the set of token states of the places from which a token may still be
being spelled, each with the place in the spelling reached; each prefix of a word has one accepted token sequence, so a transition emits just one token, that
sequence's last. Transitions are put into a table when first met (`Automaton._compose`); from then on a symbol costs one lookup. At a word's end the
emitted tokens are followed back by their lengths: no place is searched or visited twice. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import pickle
import struct
import unicodedata
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkernel as tk
from .scratch import small_batches

#: Distinct words in a task's table before it becomes the older one of two; transitions in its table before it is begun anew.
MAX_WORDS, MAX_MOVES = 150_000, 400_000
#: Where a composed state's table of moves holds the state itself; symbols are 0 to 511.
MEMBERS = -1
#: The splitter that byte-level vocabularies use when their file names none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Splitters whose matches hold no blank and look at nothing around them: a text may be cut at blanks first.
LOCAL_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def gadgets(merges: list[tuple[int, int, int]], tokens) -> tuple[dict[int, int], list[dict[int, int]]]:
    """(T, lost): the state each token leads to, and each state's lost arcs with the time of the loss.

    merges: (u, v, uv) in order. States that lost the same arcs are one.
    """
    leads: dict[int, dict[int, int]] = {t: {} for t in tokens}
    for time, (u, v, w) in enumerate(merges):
        leads[w] = dict(leads[v])  # T(v) before the gadget
        leads[u][v] = time
    number: dict[tuple, int] = {}
    lost: list[dict[int, int]] = []
    to = {}
    for t, arcs in leads.items():
        key = tuple(arcs.items())
        if key not in number:
            number[key] = len(lost)
            lost.append(arcs)
        to[t] = number[key]
    return to, lost


class Automaton:
    """The compiled merges of one vocabulary as flat tables (token states, arcs, spellings), and the symbol table grown from them.

    Compiled once for a job; the tables are all that is sent to tasks.
    """

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str):
        numbers = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        made = {w for _, _, w in numbers}
        spelling: dict[int, list[int]] = {}
        for text, i in vocab.items():
            last = bool(end) and text.endswith(end)
            stem = text[: -len(end)] if last else text
            if (i in made or len(stem) == 1) and stem and all(c in byte for c in stem):
                codes = [byte[c] for c in stem]
                spelling[i] = [*codes[:-1], codes[-1] + 256 * last]
        self.width = max(vocab.values()) + 1
        to, lost = gadgets(numbers, spelling)
        self.start = len(lost)  # before a word: a state that lost nothing
        per_token = lambda values, none: array("i", [values.get(t, none) for t in range(self.width)])
        self.to, self.length = per_token(to, -1), per_token({i: len(s) for i, s in spelling.items()}, 0)
        self.left, self.made = per_token({w: u for u, _, w in numbers}, -1), per_token({n[2]: time for time, n in enumerate(numbers)}, 0)
        # the lost arcs: each state's tokens in order from first[state] on, and the time of each
        sizes, token = [len(arcs) for arcs in lost], np.array([t for arcs in lost for t in arcs], dtype="<i4")
        self.first = array("i", [0, *np.cumsum(sizes).tolist(), sum(sizes)])
        order = np.lexsort((token, np.repeat(np.arange(len(lost)), sizes)))
        self.arcs = array("i", token[order].tobytes())
        self.times = array("i", np.array([time for arcs in lost for time in arcs.values()], dtype="<i4")[order].tobytes())
        # spellings as a tree: the node that a node and a symbol lead to, and the token that ends at a node
        self.child: dict[int, int] = {}
        ends, inner = [-1], [False]
        for i, codes in spelling.items():
            node = 0
            for c in codes:
                inner[node] = True
                step = self.child.get(node << 9 | c)
                if step is None:
                    step = self.child[node << 9 | c] = len(ends)
                    ends.append(-1)
                    inner.append(False)
                node = step
            ends[node] = i
        self.ends, self.inner = array("i", ends), bytearray(inner)
        self.known: dict[tuple, dict] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the symbol table; it is grown anew from the compiled tables. States refer to each other, so they are emptied first."""
        for moves in self.known.values():
            moves.clear()
        members = (self.start, 0)
        self.begin: dict[int, tuple] = {MEMBERS: members}
        self.known, self.moves = {members: self.begin}, 0

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the token automaton has an arc `token` from `state`."""
        until, arcs, low, high = 1 << 30, self.arcs, self.first[state], self.first[state + 1]
        while token >= 0:
            at = bisect_left(arcs, token, low, high)
            if at < high and arcs[at] == token and self.times[at] <= until:
                return False
            until, token = self.made[token], self.left[token]
        return True

    def _compose(self, moves: dict[int, tuple], symbol: int) -> tuple[dict, int]:
        """The transition of a composed state on a symbol: the moves of the state it leads to, and the token emitted."""
        going: list[int] = []
        emitted, members = -1, moves[MEMBERS]
        for k in range(0, len(members), 2):
            node = self.child.get(members[k + 1] << 9 | symbol)
            if node is None:
                continue
            token = self.ends[node]
            if emitted < 0 <= token and self.has_arc(members[k], token):
                emitted = token
            if self.inner[node]:
                going += (members[k], node)
        if emitted < 0:
            raise ValueError("the vocabulary lacks a base symbol of the word")
        found = (*going, self.to[emitted], 0)
        to = self.known.get(found)
        if to is None:
            to = self.known[found] = {MEMBERS: found}
        self.moves += 1
        move = moves[symbol] = (to, emitted)
        return move

    def encode(self, symbols) -> list[int]:
        """Ids of one pre-split word, given as symbols: one table lookup for each."""
        if self.moves > MAX_MOVES:
            self.reset()
        moves, out = self.begin, []
        for symbol in symbols:
            moves, token = moves.get(symbol) or self._compose(moves, symbol)
            out.append(token)
        ids, at, length = [], len(out), self.length
        while at:
            token = out[at - 1]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids


def _steps(node, key: str) -> list[dict]:
    return [] if node is None else [s for n in node[key] for s in _steps(n, key)] if node["type"] == "Sequence" else [node]


def _pattern(node: dict) -> str:
    return node["Regex"] if "Regex" in node else regex.escape(node["String"])


def _spans(codes: list[int], put: str) -> str:
    """A set of the regex module for ascending code points, after the operator `put`; nothing where there are none."""
    heads = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    tails = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return f"{put}[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(heads, tails)) + "]" if codes else ""


@functools.lru_cache(maxsize=1)
def library_characters() -> tuple[dict[str, str], dict[int, str], str]:
    """(classes, lower, first): how the tokenizers library differs from the tables here, asked of it when a vocabulary is compiled.

    classes: for the letters and numbers of a splitter, a set of the regex module that holds just what they match in the library, whose Unicode version is
    another one; asked are the code points on which the regex module and Python's own tables disagree, as its version lies between theirs. lower: what the
    library makes of capitals that Python does not know yet. first: the lowest character that any of this is about.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    kind = {c: unicodedata.category(chr(c)) for c in codes}
    classes, first = {}, 0x110000
    for name in ("L", "N"):
        known = {ord(c) for c in regex.findall(rf"\p{{{name}}}", text)}
        asked = sorted(known ^ {c for c, k in kind.items() if k[0] == name})
        kept = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed").pre_tokenize_str("".join(map(chr, asked)))
        other = {ord(c) for piece, _ in kept for c in piece}
        less, more = sorted(known & other), sorted(set(asked) - other - known)
        first = min([first, *less, *more])
        classes[rf"\p{{{name}}}"] = f"[[\\p{{{name}}}{_spans(more, '||')}]{_spans(less, '--')}]"
    new = "".join(chr(c) for c in codes if kind[c] == "Cn")
    lower = normalizers.Lowercase().normalize_str(new)
    changed = {ord(a): b for a, b in zip(new, lower) if a != b} if len(lower) == len(new) else {}
    return classes, changed, chr(min([first, *changed, 0x10FFFF]))


class Tokenizer:
    """A vocabulary file's normaliser, splitter, automaton and decoder, for use inside a task; what it can't do as the file says is an error."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        model = d["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE model")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("added tokens must stand for themselves")
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.auto = Automaton(merges, {t: i for t, i in model["vocab"].items() if t not in self.added}, self.end)
        label = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        classes, self.lower, self.first = library_characters()
        self.steps = _steps(d["normalizer"], "normalizers")
        self.normal = [self._normal(s, self.lower) for s in self.steps]
        self.kinds = [s["type"] for s in _steps(d["normalizer"], "normalizers")]
        self.split, self.prefix, self.kept_only = None, False, False
        byte_level = False
        for s in _steps(d["pre_tokenizer"], "pretokenizers"):
            if s["type"] == "Split" and self.split is None and (s["behavior"], s["invert"]) in (("Removed", True), ("Isolated", False), ("Isolated", True)):
                self.split, self.kept_only = _pattern(s["pattern"]), s["behavior"] == "Removed"
            elif s["type"] == "ByteLevel" and not byte_level and not (s["use_regex"] and self.split):
                byte_level, self.prefix = True, s["add_prefix_space"]
                self.split = BYTE_LEVEL_PATTERN if s["use_regex"] else self.split
            else:
                raise ValueError(f"no pre-tokenizer {s['type']}")
        if not byte_level:
            raise ValueError("not a byte-level vocabulary")
        kind = (d["decoder"] or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder {kind}")
        self.join = b"" if kind else b" "
        byte = {s: b for b, s in enumerate(byte_symbols())}
        as_bytes = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.labels = [b""] * (max(label) + 1)
        for i, t in label.items():
            self.labels[i] = as_bytes(t) if kind else t.encode()
        # words of a text cut at blanks are met again and again, so whole pieces are remembered
        self.local = self.split in LOCAL_PATTERNS and self.kept_only and not self.prefix and self.kinds == ["NFC", "Replace", "Lowercase"]
        exact = self.split
        for name, held in classes.items():
            exact = exact and exact.replace(name, held)
        # the plain one is quicker, and the same where no character is disputed
        self.split, self.exact = (regex.compile(self.split), regex.compile(exact, regex.V1)) if self.split else (None, None)
        self.space = regex.compile(r"\s+")
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of the texts seen."""
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.auto.reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "normal"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.normal = [self._normal(s, self.lower) for s in self.steps]

    @staticmethod
    def _normal(s: dict, lower: dict[int, str]):
        if s["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
            return lambda t: t if t.isascii() else unicodedata.normalize(s["type"], t)
        if s["type"] == "Lowercase":
            # lower() would look at what follows a capital sigma
            return lambda t: t.lower() if t.isascii() else t.replace("Σ", "σ").lower().translate(lower)
        if s["type"] == "Replace":
            found, put = regex.compile(_pattern(s["pattern"])), s["content"]
            return lambda t: found.sub(lambda _: put, t)
        raise ValueError(f"no normaliser {s['type']}")

    def _words(self, text: str) -> list[str]:
        if self.split is None:
            return [text] if text else []
        split = self.split if text.isascii() or max(text) < self.first else self.exact
        if self.kept_only:
            return split.findall(text)
        words, at = [], 0
        for m in split.finditer(text):
            words += [text[at : m.start()], m[0]]
            at = m.end()
        return [w for w in (*words, text[at:]) if w]

    def _word(self, word: str) -> tuple[bytes, bytes]:
        codes = word.encode()
        ids = self.auto.encode([*codes[:-1], codes[-1] + 256] if self.end else codes)
        return struct.pack(f"<{len(ids)}I", *ids), self.join.join([self.labels[i] for i in ids])

    def _piece(self, piece: str, whole: bool = False) -> tuple[bytes, bytes]:
        """(packed ids, labels) of a piece, remembered; of one word if it is whole."""
        out, asked = self.table.get(piece) or self.older.get(piece), piece
        if out is None:
            if self.local and not piece.isascii() and max(piece) >= self.first:
                piece = piece.translate(self.lower)
            words = [piece] if whole or not self.local else self._words(piece)
            if words == [piece]:
                out = self._word(piece)
            else:
                parts = [self._piece(w, True) for w in words]
                out = b"".join([p[0] for p in parts]), self.join.join([p[1] for p in parts])
        if len(self.table) >= MAX_WORDS:
            self.older, self.table = self.table, {}
        self.table[asked] = out
        return out

    def _plain(self, text: str, packed: list[bytes], labels: list[bytes]) -> None:
        if self.local:  # the same as the steps below, for whole pieces
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
            pieces = self.space.split(text) if odd else text.split()
        else:
            for step in self.normal:
                text = step(text)
            pieces = self._words(" " + text if self.prefix and text and not text[0].isspace() else text)
        got = list(map(self.table.get, pieces))
        if None in got:
            got = [g or self._piece(p) for g, p in zip(got, pieces) if p]
        packed += [g[0] for g in got if g[0]]
        labels += [g[1] for g in got if g[0]]

    def run(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        packed: list[bytes] = []
        labels: list[bytes] = []
        text, at = text or "", 0
        for m in self.cut.finditer(text) if any(t in text for t in self.added) else ():
            self._plain(text[at : m.start()], packed, labels)
            packed.append(struct.pack("<I", self.added[m[0]]))
            labels.append(m[0].encode())
            at = m.end()
        self._plain(text[at:] if at else text, packed, labels)
        return b"".join(packed), self.join.join(labels).decode("utf-8", "replace")


def _compiled(df: DataFrame, vocab_path: str):
    """The vocabulary compiled in a task and broadcast: tables of fixed size, about 20 MB for 50,000 merges.

    Compiling and asking the library take some 300 MB for a moment, which the driver need not have; it gets the tables, 8 MB as they are sent.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocab_path, "rb") as f:
        spec = f.read()

    def build(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tokenizer(spec))], pa.binary())], names=["tables"])

    tables = spark.range(1, numPartitions=1).mapInArrow(tk.tidy(build), "tables binary").first()[0]
    return spark.sparkContext.broadcast(pickle.loads(tables))


def _forgetting(run, shared):
    """run(tokenizer, batches) as a function over Arrow batches that leaves nothing remembered in its worker.

    Until then the cyclic collector rests: it would walk the growing tables again and again, and `Automaton.reset` frees them itself.
    """

    def wrapped(batches):
        tok, collects = shared.value, gc.isenabled()
        gc.disable()
        try:
            yield from run(tok, batches)
        finally:
            tok.forget()
            if collects:
                gc.enable()

    return tk.tidy(wrapped)


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row; rows keep their partitions, nothing is shuffled.

    vocab_path: a byte-level BPE file, read once on the driver and compiled once in a task; its tables (fixed, about 20 MB) are broadcast. A file that asks for a step not known here is an error. A null or empty text gives no ids and an empty string. Special tokens written
    in a text become their ids, as that file's library does. Very long texts are handled whole, one at a
    time. Repeated rows and null ids come out as often as they came in; other columns are not looked at.
    """
    shared = _compiled(df, vocab_path)

    def encode(tok, batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [tok.run(t) for t in part.column(1).to_pylist()]
                off = np.cumsum([0, *(len(g[0]) // 4 for g in got)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(g[0] for g in got), dtype="<i4"), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(off), ids), pa.array([g[1] for g in got], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_forgetting(encode, shared), f"`{id_col}` {kind}, ids array<int>, decoded string")


def bpe_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): `bpe_encode` reduced to digests inside the task.

    The cases are those of `bpe_encode`; an empty text has 0 tokens and the digests of nothing.
    """
    shared = _compiled(df, vocab_path)

    def digest(tok, batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids, text = [], [], []
            for t in batch.column(1):
                packed, decoded = tok.run(t.as_py())
                n.append(len(packed) // 4)
                ids.append(sha(packed))
                text.append(sha(decoded.encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        _forgetting(digest, shared), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
