"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three machines:

* the normaliser: white-space rules of the model (dummy prefix, removal of extra spaces, spaces to U+2581); character maps are
  rejected unless they are the identity, as in models with byte fallback;
* the piece transducer: a trie from characters to piece ids; an arc path that spells a piece emits its id. Characters that
  no piece covers go through the byte-fallback arcs, one byte piece per UTF-8 byte;
* for models trained by merging, an acceptor over piece pairs: weight 0 if merging the text of both pieces gives back just
  these two, infinity otherwise. A segmentation is what merging yields exactly if each piece merges to itself and each
  neighbouring pair is accepted, so of all paths through the composition exactly one has a finite weight. For unigram models
  an arc weighs minus the piece's score instead and every pair is accepted.

Encoding composes the machines with the text and takes the shortest path in the tropical semiring (min, +), by one pass from left
to right: per position the least weight so far and the last piece. No piece spans certain borders (U+2581 behind another
character; two characters that stand side by side in no piece), so there the composition falls apart, and the shortest
path of a text is the concatenation of those of its parts. Parts that repeat are looked up in a bounded table per task.

Decoding is the inverse: pieces to text, byte pieces to bytes, U+2581 to spaces, without the dummy prefix.

Defined cases: null text stays null in ids and decoded text; the empty text has no ids; very long texts and words are encoded
whole; bytes that are no UTF-8 decode to U+FFFD; control and unknown ids decode to nothing and U+2047; repeated rows are
encoded alike; an empty table gives an empty result; other columns pass through `encode`, whatever their names.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import extended, mapped, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Codes of the model file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITY = float("inf")
#: Parts whose paths one task keeps; beyond it the table starts anew.
MEMORY = 1 << 19
#: Arc numbers: piece ids, the start of a text, and characters without a piece from LOOSE on; PAIR numbers pairs of arcs.
START, LOOSE, PAIR = (1 << 22) - 1, 1 << 22, 1 << 23


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    dummy_prefix: bool = True
    trim: bool = True
    mark: bool = True


def messages(data: bytes):
    """(field, value) pairs of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, data[at:at + size]
        at += size


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in messages(data):
        if number == 1:
            piece = dict(messages(value))
            score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(messages(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(messages(value))
            if rules.get(2):
                raise ValueError("character maps of the normaliser are not supported; only the identity is")
            model.dummy_prefix, model.trim, model.mark = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and merge models have a piece transducer")
    model.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    return model


class Transducer:
    """Normaliser, piece trie, byte fallback and pair acceptor of one model."""

    def __init__(self, model: Model):
        self.model = model
        self.scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        if model.byte_fallback and len(self.bytes) < 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        self.merging = model.kind == BPE
        # Texts of ids; bytes from 0x80 on only mean something together.
        self.high = frozenset(i for b, i in self.bytes.items() if b >= 0x80)
        self.texts = [{UNKNOWN: " ⁇ ", CONTROL: ""}.get(kind, p.replace(SPACE_MARK, " ") if model.mark else p)
                      for p, _, kind in model.pieces]
        for b, i in self.bytes.items():
            self.texts[i] = chr(b)
        self.least = min(self.scores.values(), default=0.0) - 10.0  # of a character that no piece covers
        # A node is [arcs by character, id of the piece that ends here or None].
        self.trie: list = [{}, None]
        for piece in self.scores:
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = self.ids[piece]
        # Characters that some piece holds next to each other; between others the composition falls apart as well.
        self.joined = {a + b for piece in self.scores for a, b in zip(piece, piece[1:])}
        # Where the composition falls apart: before a mark that follows another character, unless a piece spans that.
        spans = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in self.scores)
        self.parts = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]*" if not spans else r"(?s:.+)", re.S)
        self.accepted: dict[int, bool] = {}
        self.steps: dict[int, tuple | None] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        m = self.model
        if m.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if m.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE_MARK) if m.mark else text

    def merging_of(self, text: str) -> tuple[list[float], list[str], list[str]] | None:
        """How merging a text by itself goes: the score of each step (highest first, leftmost of equals), and the first and last
        symbol before and after each. None if it does not end in the text as one piece."""
        symbols = list(text)
        scores, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = -INFINITY, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return None
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return [*scores, -INFINITY], firsts, lasts

    def alone(self, arc: int):
        """merging_of an arc's text, computed once per arc."""
        if arc not in self.steps:
            self.steps[arc] = self.merging_of(self.name(arc))
        return self.steps[arc]

    def undisturbed(self, left: int, right: int) -> bool:
        """Whether merging the texts of two arcs together leaves both whole: their own steps are taken in the order of scores, and
        no step may join what touches at the border before both are done."""
        theirs = self.alone(right)
        if left == START or theirs is None:
            return theirs is not None
        mine = self.alone(left)
        if mine is None:
            return False
        (steps, _, lasts), (other, firsts, _) = mine, theirs
        i = j = 0
        while True:
            ahead, behind = steps[i], other[j]
            across = self.scores.get(lasts[i] + firsts[j])
            if across is not None and across > ahead and across >= behind:
                return False
            if ahead == behind == -INFINITY:
                return True
            if ahead >= behind:
                i += 1
            else:
                j += 1

    def name(self, ident: int) -> str:
        """Text of an arc: a piece, or the one character that no piece covers."""
        return chr(ident - LOOSE) if ident >= LOOSE else self.model.pieces[ident][0]

    def accept(self, left: int, right: int) -> bool:
        """The pair acceptor of merge models: whether merging leaves these neighbours alone."""
        good = self.undisturbed(left, right)
        if len(self.accepted) >= MEMORY:
            self.accepted.clear()
        self.accepted[left * PAIR + right] = good
        return good

    def arcs(self, text: str, start: int):
        """(end, id) of the arc paths of the trie from `start`; a character without a piece is an arc of its own."""
        node, single = self.trie, False
        for at in range(start, len(text)):
            node = node[0].get(text[at])
            if node is None:
                break
            if node[1] is not None:
                single = single or at == start
                yield at + 1, node[1]
        if not single:
            yield start + 1, LOOSE + ord(text[start])

    def shortest(self, text: str) -> list[int]:
        """Arcs on the path of least weight from left to right: per position the least weight so far, where it came from and by
        which arc. In merge models the weights are 0 and infinity and one path alone is finite, so the first to reach a
        position with weight 0 is it, and the last arc is all the acceptor has to remember."""
        n = len(text)
        reached: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        reached[0] = START
        accepted, merging = self.accepted, self.merging
        weight = [] if merging else [0.0] + [INFINITY] * n
        for at in range(n):
            last = reached[at]
            if last is None:
                continue
            if merging:  # the same arcs as below, walked in place: this loop is where encoding spends its time
                base, node, end = last * PAIR, self.trie, at
                single = False
                while end < n:
                    node = node[0].get(text[end])
                    if node is None:
                        break
                    end += 1
                    arc = node[1]
                    if arc is not None:
                        single = single or end == at + 1
                        if reached[end] is None:
                            good = accepted.get(base + arc)
                            if good or good is None and self.accept(last, arc):
                                reached[end], came[end] = arc, at
                if not single and self.accept(last, LOOSE + ord(text[at])):
                    reached[at + 1], came[at + 1] = LOOSE + ord(text[at]), at
                continue
            for end, arc in self.arcs(text, at):
                total = weight[at] - (self.model.pieces[arc][1] if arc < LOOSE else self.least)
                if total < weight[end]:
                    weight[end], reached[end], came[end] = total, arc, at
        out, at = [], n
        while at:
            out.append(reached[at])
            at = came[at]
        return out[::-1]

    def emit(self, arc: int) -> list[int]:
        if arc < LOOSE:
            return [arc]
        return [self.bytes[b] for b in chr(arc - LOOSE).encode()] if self.model.byte_fallback else [self.model.unknown]

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part, cut where no piece joins two neighbours; parts and cuts are remembered."""
        known = self.known
        cuts = [i for i, pair in enumerate(map(add, part, part[1:]), 1) if pair not in self.joined]
        if cuts:
            ids, start = [], 0
            for end in [*cuts, len(part)]:
                ids += known.get(part[start:end]) or self.part_ids(part[start:end])
                start = end
        else:
            ids = [i for arc in self.shortest(part) for i in self.emit(arc)]
        if len(part) <= 64:
            if len(known) >= MEMORY:
                known.clear()
            known[part] = tuple(ids)
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.parts.findall(self.normalise(text)):
            if part:
                out += known.get(part) or self.part_ids(part)
        if not self.model.byte_fallback:  # neighbouring unknown characters share one id
            out = [i for n, i in enumerate(out) if i != self.model.unknown or n == 0 or out[n - 1] != i]
        return out

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join([self.texts[i] for i in ids])
        else:
            out, held = [], bytearray()
            for i in ids:
                if i in self.high:
                    held.append(int(self.model.pieces[i][0][3:5], 16))
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.texts[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Model:
    """Read on the driver; tasks receive the parsed pieces (their number is fixed by the model)."""
    with open(path, "rb") as f:
        return read_model(f.read())


COLUMNS = (("piece_ids", "array<int>"), ("piece_count", "bigint"), ("piece_decoded", "string"))


def encode(docs: DataFrame, model: Model | None = None, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """`docs` with piece_ids, their number, and the text decoded from them."""
    import pyarrow as pa

    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or load())  # bounded by the vocabulary
    at = docs.columns.index(text_col)
    columns = COLUMNS if decoded else COLUMNS[:2]

    def run(batches):
        machine = Transducer(shared.value)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                ids = [None if t is None else machine.encode(t) for t in part.column(at).to_pylist()]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array([None if i is None else len(i) for i in ids], pa.int64())]
                if decoded:
                    new.append(pa.array([None if i is None else machine.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(c for c, _ in columns)])

    return mapped(docs, run, extended(docs.schema, columns))


def decode(rows: DataFrame, ids_col: str = "piece_ids", model: Model | None = None) -> DataFrame:
    """`rows` with piece_decoded, the text of the ids."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(model or load())
    at = rows.columns.index(ids_col)

    def run(batches):
        machine = Transducer(shared.value)
        for batch in batches:
            texts = [None if i is None else machine.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, COLUMNS[2][0]])

    return mapped(rows, run, extended(rows.schema, COLUMNS[2:]))


def op8_sentencepiece(spark, sf_dir):
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "piece_ids", F.col("piece_count").alias("n_pieces"),
                       F.col("piece_decoded").eqNullSafe(F.col("text")).alias("round_trip"))


QUERIES = {"op8_sentencepiece": (op8_sentencepiece, None)}
