"""Exact encoding and decoding with a SentencePiece merge (BPE) vocabulary, without the library's encoder.

A text becomes U+2581 for spaces behind one added U+2581, and splits where no vocabulary piece can span: before a run
of U+2581, around characters that no piece holds (those turn into byte pieces), and between letters and other
characters, as far as no piece holds both side by side. Each segment is encoded by backtracking. One scan of an Aho-Corasick automaton over the pieces names the longest match at each position of a
segment, and one over a piece its next shorter prefix; a piece may follow another if re-merging the two by the plain merge rule leaves them as they are; a
bitfield remembers positions from which no valid ending was found, so no position fails twice.

Runs of two or more U+2581 are the one place where the vocabulary has ties (all such pieces score the same, lowest),
so that pairwise compatibility is not defined there. Such merges come last, after all others of their segment, so the
run is split off and merged by the plain rule.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results; very long segments
take time linear in their length (merging alone: n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docscope.llm.common import kept_by, lean, ship, table

MARK = "▁"
#: Segments kept with their ids, for one Python worker (about 40 MB), in two halves: when one is full the other is
#: forgotten, so segments in use stay. Longer ones are not kept.
MEMO, MEMO_CHARS = 200_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """Values made at their first use by ``make``, which also says what is kept."""

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class PieceCodec:
    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that hold a space after a letter are not supported")
        self.known = {c for p in self.id for c in p}
        self.trie = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self.merge(p) == [p]:  # others no merge can reach
                self.trie.add_word(p, p)
        self.trie.make_automaton()
        self._pairs = _Memo(self._fits)
        self._less: dict[str, str | None] = {}
        self._name = {p: str(i) for p, i in self.id.items()}
        self._memo, self._older = _Memo(self._ids_of), {}
        self._unlike: dict[str, str] = {}
        # Spaces stand for U+2581 from here on: shorter strings, and no copies of whole texts.
        odd = re.escape("".join(sorted(c for c in map(chr, range(32)) if c not in self.known)))
        letters = re.escape("".join(sorted(self._letters())))
        others = f"[^\\x20{odd}{letters}]"
        self._split = re.compile(f"\\x20+(?:[{letters}]+|{others}*)|[{letters}]+|{others}+|(?s:.)")

    def _letters(self) -> set[str]:
        """The characters that pieces connect with "a": no piece holds one of them beside one that is not."""
        beside: dict[str, set[str]] = {}
        for p in self.id:
            body = p.lstrip(MARK)
            for x, y in zip(body, body[1:]):
                beside.setdefault(x, set()).add(y)
                beside.setdefault(y, set()).add(x)
        found, todo = {"a"}, ["a"]
        while todo:
            new = beside.get(todo.pop(), set()) - found
            found |= new
            todo += new
        return found

    def merge(self, text: str) -> list[str]:
        """The plain merge rule: always the best-scored adjacent pair, the leftmost of equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _fits(self, pair: tuple[str, str]) -> bool:
        if len(self._pairs) >= MEMO:
            self._pairs.clear()
        got = self._pairs[pair] = self.merge(pair[0] + pair[1]) == [*pair]
        return got

    def _longest(self, text: str) -> list[str | None]:
        """For each position the longest piece from there on that merges can reach, by one scan of the automaton."""
        out: list[str | None] = [None] * len(text)
        for end, piece in self.trie.iter(text):  # by their ends, so a later match from a position is a longer one
            out[end + 1 - len(piece)] = piece
        return out

    def _next(self, piece: str) -> str | None:
        """The longest reachable piece that is a proper prefix of ``piece``."""
        if (got := self._less.get(piece, "")) == "":
            got = self._less[piece] = self._longest(piece[:-1])[0] if len(piece) > 1 else None
        return got

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters that holds no two adjacent U+2581."""
        n, at, out = len(text), 0, []
        closed: bytearray | None = None  # a bit for each position, made when the first one fails
        pairs, longest = self._pairs, self._longest(text)
        piece, last = longest[0], None
        while at < n:
            if piece is None:
                if closed is None:
                    closed = bytearray(n // 8 + 1)
                closed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the vocabulary was not made by merges: a text has no valid cut into pieces")
                at -= len(piece := out.pop())
                piece, last = self._next(piece), out[-1] if out else None
                continue
            end = at + len(piece)
            if (closed is None or not closed[end >> 3] >> (end & 7) & 1) and (last is None or pairs[last, piece]):
                out.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else None
            else:
                piece = self._next(piece)
        return out

    def _ids_of(self, seg: str) -> str:
        """The ids of a segment that is not among the latest ones."""
        if (got := self._older.get(seg)) is None:
            got = self._segment(seg.replace(" ", MARK))
        if len(seg) <= MEMO_CHARS:
            if len(self._memo) >= MEMO // 2:
                self._older = dict(self._memo)
                self._memo.clear()
            self._memo[seg] = got
        return got

    def _segment(self, seg: str) -> str:
        """The segment's ids; its text goes to ``_unlike`` where decoding gives other characters than it had."""
        body = seg.lstrip(MARK)
        marks = len(seg) - len(body)
        if self.known.issuperset(body):  # the pieces put together are the segment
            return ",".join([self._name[p] for p in self._run(body, marks)])
        ids: list[int] = []
        run = ""
        for c in body:
            if c in self.known:
                run += c
                continue
            ids += [self.id[p] for p in self._run(run, marks)] if run or marks else []
            run, marks = "", 0
            ids += [self.byte_id[b] for b in c.encode()]
        ids += [self.id[p] for p in self._run(run, marks)] if run or marks else []
        text, plain = self._text(ids), seg.replace(MARK, " ")
        if text != plain:
            self._unlike[plain] = text
        return ",".join(map(str, ids))

    def _run(self, body: str, marks: int) -> list[str]:
        lead = MARK if marks else ""
        parts = self.backtrack(lead + body) if lead + body else []
        if marks > 1:
            parts = self.merge(MARK * marks) + parts[1:] if parts[0] == MARK else self.merge(MARK * (marks - 1)) + parts
        return parts

    def _text(self, ids: list[int]) -> str:
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._text(ids)
        return text[1:] if text[:1] == " " else text

    def parts(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, how many, the text that they decode to)."""
        if not text:
            return "", 0, ""
        if len(self._unlike) >= MEMO // 20:  # what it says of kept segments goes with them
            for kept in (self._memo, self._older, self._unlike):
                kept.clear()
        plain = " " + (text.replace(MARK, " ") if MARK in text else text)
        segments = self._split.findall(plain)
        ids = ",".join(map(self._memo.__getitem__, segments))
        if self._unlike:
            return ids, ids.count(",") + 1, "".join(map(self._unlike.get, segments, segments))[1:]
        return ids, ids.count(",") + 1, plain[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.parts(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []


_codecs: dict[str, PieceCodec] = kept_by(__name__, {})


def codec(model: str) -> PieceCodec:
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def encode_documents(docs: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])`` for every row of ``docs``.

    ``model`` is the vocabulary's path on the workers; without one each worker asks the public tokenizer package.
    """

    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model or default_model())
        for batch in batches:
            n, hid, hdec, ids, dec = [], [], [], [], []
            for text in batch.column("text"):
                a, count, b = own.parts(text.as_py() or "")
                n.append(count)
                hid.append(hashlib.sha256(a.encode()).hexdigest())
                hdec.append(hashlib.sha256(b.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(i) for i in a.split(",")] if a else [])
                    dec.append(b)
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hid, pa.string()), pa.array(hdec, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(dec, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(lean(run, __name__), schema)


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
