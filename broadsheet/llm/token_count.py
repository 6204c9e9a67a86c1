"""Token counts by dynamic programming over prefixes.

A word-level BPE never merges across the pieces that its pre-tokenizer cuts, so the count at a prefix
of a text is the sum over its whole pieces plus the count of the piece that the prefix breaks off in.
Within a piece, a sequence of tokens is the encoding of what it spells just when every two neighbours
encode to themselves. So the encoding of each prefix of a piece is that of a shorter prefix and one
token more, and its count is one more than the count stored there. Questions about truncation and
budgets read the stored counts and encode nothing again.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import PreTokenizedString, Tokenizer

from broadsheet.llm.common import table

TOKENIZER = "word_bpe_49k.json"
#: A document with more tokens is over the limit.
LIMIT = 2048
#: Bytes of a generation of each of a worker's six caches, and the longest key that they keep.
REMEMBERED = 32 << 20
KEPT = 64
#: Letters of a word whose table is kept for other words that begin alike.
HEAD = 6
#: Characters whose classes are the same in every version of Unicode: up to U+024F. Runs without blanks
#: that have others, or the separators U+001C to U+001F, are cut into pieces by the library.
UNSURE = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zªµºß-öø-ɏ²³¹¼-¾]+")
#: No piece and no normal form reaches over these blanks.
RUN = re.compile("[^ \t-\r]+")
#: Two blanks, which the normal form makes one.
BLANK = re.compile("[^\\S\x1c-\x1f]{2}")
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(seen))}


class Remembered(dict):
    """A cache that asks `compute` for what it lacks. Of two generations the older goes when the younger holds REMEMBERED bytes.

    `each` is what an entry takes beside its key, in bytes. Texts of more than KEPT letters are not kept.
    """

    def __init__(self, compute, each: int) -> None:
        super().__init__()
        self.compute, self.each = compute, each
        self.held = 0
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if type(key) is str and len(key) > KEPT:
            return value
        self.held += sys.getsizeof(key) + self.each
        if self.held > REMEMBERED:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value


class PrefixCounter:
    """Exact counts of a BPE with word ends at every prefix of a text."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.vocab = frozenset(model["vocab"])
        self.reach = self._reach(token for token in self.vocab if not token.endswith(END))
        self.reach_ended = self._reach(token.removesuffix(END) for token in self.vocab if token.endswith(END))
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in told["added_tokens"]) + ")")
        self.letters = byte_letters()
        self.furthest = max(*self.reach.values(), *self.reach_ended.values(), 2)
        self.edges = Remembered(self._edges, 2000)
        self.fits = Remembered(self._fits, 200)
        self.head = Remembered(lambda word: self._stems(word, [""], [0]), 1000)
        self.count_piece = Remembered(lambda piece: self._count_word(self.spelt(piece)), 100)
        self.count_word = Remembered(self._count_word, 100)
        self.count_run = Remembered(self._count_run, 100)

    @staticmethod
    def _reach(tokens: Iterable[str]) -> dict[str, int]:
        """The most letters of a token that ends in the same two letters, or is no longer than they are."""
        reach: dict[str, int] = {}
        for token in tokens:
            reach[token[-2:]] = max(reach.get(token[-2:], 1), len(token))
        return reach

    def _edges(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands at a token's left and at its right end as it is put together, each with the rank at which it goes into the next.

        None for a token that its own letters do not make.
        """
        symbols = [*token.removesuffix(END)] if token.endswith(END) and token != END else [*token] if token != END else [token]
        if token.endswith(END) and token != END:
            symbols[-1] += END
        left, right = [(symbols[0], math.inf)], [(symbols[-1], math.inf)]
        while len(symbols) > 1:
            best = min(self.rank.get(p, math.inf) for p in zip(symbols, symbols[1:], strict=False))
            if best == math.inf:
                return None
            out, i = [], 0
            while i < len(symbols):
                joins = i + 1 < len(symbols) and self.rank.get((symbols[i], symbols[i + 1])) == best
                out.append(symbols[i] + symbols[i + 1] if joins else symbols[i])
                i += 1 + joins
            for ends, now in ((left, out[0]), (right, out[-1])):
                if now != ends[-1][0]:
                    ends[-1] = (ends[-1][0], best)
                    ends.append((now, math.inf))
            symbols = out
        return left, right

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens, the first perhaps '', stay as they are when encoded side by side.

        They do unless, at some time while both are put together, what stands at the first one's right end
        and the second one's left end join each other before either joins its own neighbour. Of pairs of one
        rank the one further left joins first.
        """
        left, right = (self.edges[t] if t else None for t in pair)
        if right is None or pair[0] and left is None:
            return False
        if not pair[0]:
            return True
        here, there, i, j = left[1], right[0], 0, 0
        while True:
            (a, a_goes), (b, b_goes) = here[i], there[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_goes and rank <= b_goes:
                return False
            if a_goes == b_goes == math.inf:
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1

    def stems(self, word: str, room: float = math.inf) -> tuple[list[str], list[int]]:
        """For every prefix of a word written in byte letters, without a word end: last token and count.

        Both end early where no longer prefix can have `room` tokens or fewer: a count is one more than one
        that stands no further back than the longest token.
        """
        last, count = self.head[word[:HEAD]]
        return (last, count) if len(word) <= HEAD else self._stems(word, last.copy(), count.copy(), room)

    def _stems(self, word: str, last: list[str], count: list[int], room: float = math.inf) -> tuple[list[str], list[int]]:
        vocab, fits, reach, beyond = self.vocab, self.fits, self.reach, 0
        for end in range(len(last), len(word) + 1):
            beyond = beyond + 1 if count[-1] >= room else 0
            if beyond > self.furthest:
                break
            for start in range(max(0, end - reach.get(word[max(0, end - 2) : end], 1)), end):
                token = word[start:end]
                if token in vocab and fits[last[start], token]:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return last, count

    def ended(self, word: str, end: int, last: list[str], count: list[int]) -> int:
        """The count of the first `end` letters as a whole word."""
        vocab, fits = self.vocab, self.fits
        for start in range(max(0, end - self.reach_ended.get(word[max(0, end - 2) : end], 1)), end):
            token = word[start:end] + END
            if token in vocab and fits[last[start], token]:
                return count[start] + 1
        raise ValueError(f"no encoding of {word!r}")

    def spelt(self, piece: str) -> str:
        """A piece in byte letters."""
        return piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())

    def _count_word(self, word: str) -> int:
        last, count = self.stems(word[:-1])
        return self.ended(word, len(word), last, count)

    def prefixes_of_piece(self, piece: str, room: float = math.inf) -> list[int]:
        """The count of each prefix of a piece, by code points from none to all, or to where no more can have `room` tokens or fewer."""
        if piece[0] == "'" and len(piece) <= 3:  # a contraction that is cut off falls into other pieces
            return [sum(map(self.count_piece.__getitem__, PIECE.findall(piece[:k]))) for k in range(len(piece) + 1)]
        word, counts, at = self.spelt(piece), [0], 0
        last, count = self.stems(word, room)
        for letter in piece:
            at += len(letter.encode())
            if at > len(last):
                break
            counts.append(self.ended(word, at, last, count))
        return counts

    def normal(self, text: str) -> str:
        """The library's normal form."""
        return self.library.normalizer.normalize_str(text)

    def pieces(self, run: str) -> list[tuple[str, int, int]]:
        """The library's pieces of a run: each in byte letters, with its start and end in code points of the run."""
        made = PreTokenizedString(run)
        made.normalize(self.library.normalizer.normalize)
        self.library.pre_tokenizer.pre_tokenize(made)
        return [(word, *at) for word, at, _ in made.get_splits("original", "char") if word]

    def _count_run(self, run: str) -> int:
        return sum(self.count_word[word] for word, _, _ in self.pieces(run))

    def table(self, text: str) -> Iterator[tuple[int, int, int, tuple[int, int]]]:
        """(start, end, tokens so far) of every piece, and where the run or special token begins and ends that it is in."""
        total = at = 0
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                total += 1
                yield at, at + len(part), total, (at, at + len(part))
            else:
                for m in RUN.finditer(part):
                    low, high = at + m.start(), at + m.end()
                    if sure(m[0]):
                        for x in PIECE.finditer(m[0].lower()):
                            total += self.count_piece[x[0]]
                            yield low + x.start(), low + x.end(), total, (low, high)
                    else:
                        for word, start, end in self.pieces(m[0]):
                            total += self.count_word[word]
                            yield low + start, low + end, total, (low, high)
            at += len(part)

    def steps(self, text: str) -> list[tuple[int, int, int]]:
        """The stored table: (start, end, tokens so far) of every piece, in code points of the text."""
        return [row[:3] for row in self.table(text)]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        parts = self.special.split(text) if "<|" in text else [text]
        if sure(text):
            return len(parts) // 2 + sum(sum(map(self.count_piece.__getitem__, PIECE.findall(part.lower()))) for part in parts[::2])
        total = len(parts) // 2
        for part in parts[::2]:
            for run in RUN.findall(part):
                total += sum(map(self.count_piece.__getitem__, PIECE.findall(run.lower()))) if sure(run) else self.count_run[run]
        return total

    def prefixes(self, text: str) -> list[int]:
        """The tokens of every prefix of a text, by code points from none to all."""
        counts, before, run = [0], 0, (0, 0)
        for start, end, total, (low, high) in self.table(text):
            special, known = self.special.fullmatch(text, low, high), sure(text[low:high])
            if special or known:
                counts.extend([before] * (start + 1 - len(counts)))
            if special:
                counts.extend(self._into_special(text, start, k, run, counts) for k in range(start + 1, end))
                counts.append(total)
            elif known:
                counts.extend(before + c for c in self.prefixes_of_piece(text[start:end].lower())[1:])
            elif (low, high) != run:
                counts.extend([before] * (low + 1 - len(counts)))
                counts.extend(before + c for c in self.prefixes_of_run(text[low:high])[1:])
            before, run = total, (low, high)
        counts.extend([before] * (len(text) + 1 - len(counts)))
        return counts

    def _into_special(self, text: str, start: int, end: int, run: tuple[int, int], counts: Sequence[int] | Mapping[int, int]) -> int:
        """The tokens of text[:end], which breaks off in a special token from `start` on: it goes on with the run that stands right before it."""
        low = run[0] if run[1] == start and not self.special.fullmatch(text, *run) else start
        return counts[low] + self.count(text[low:end])

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that has at most `budget` tokens."""
        before, base, run, last = 0, 0, (0, 0), (0, 0, 0)
        for start, end, total, (low, high) in self.table(text):
            if (low, high) != run:
                last, base, run = (*run, base), before, (low, high)
            if total > budget:
                if self.special.fullmatch(text, low, high):
                    counts = dict.fromkeys([start], before) | {last[0]: last[2]}
                    return next((k for k in range(end - 1, start, -1) if self._into_special(text, start, k, last[:2], counts) <= budget), start)
                if sure(text[low:high]):
                    counts = self.prefixes_of_piece(text[start:end].lower(), budget - before)
                    return start + max((k for k, c in enumerate(counts) if before + c <= budget), default=0)
                counts = self.prefixes_of_run(text[low:high], budget - base)
                return low + max(k for k, c in enumerate(counts) if c <= budget - base)
            before = total
        return len(text)

    def _clusters(self, run: str) -> list[tuple[str, str]] | None:
        """A run cut where nothing that follows changes the normal form of what stands before: each part with its normal form.

        None where the library's normal form of the whole is another than that of the parts.
        """
        starts = [0]
        for i in range(1, len(run)):
            c = run[i]
            if not (BLANK.match(run[i - 1 : i + 1]) or unicodedata.combining(c) or c in joining()):
                starts.append(i)
        parts = [run[a:b] for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
        forms = {part: self.normal(part) for part in set(parts)}
        return [(part, forms[part]) for part in parts] if "".join(map(forms.__getitem__, parts)) == self.normal(run) else None

    def _cut(self, normal: str) -> list[tuple[str, int, int]]:
        """The library's pieces of a text in normal form: each in byte letters, with its start and end in code points."""
        made = PreTokenizedString(normal)
        self.library.pre_tokenizer.pre_tokenize(made)
        return [(word, *at) for word, at, _ in made.get_splits("original", "char") if word]

    def prefixes_of_run(self, run: str, room: float = math.inf) -> list[int]:
        """The tokens of every prefix of a run, by code points from none to all, or to where no more can have `room` or fewer.

        What a prefix adds to the whole parts before it is cut together with the last letters of those: three,
        back to where a piece begins, of which a longer piece gives two. Only the end of its last piece is new, and
        the counts that are stored at the letters before it are read and not made again. So time goes with the
        length of the run, but for the square of the length of a letter with all its marks.
        """
        clusters = self._clusters(run)
        if clusters is None:
            return [self._count_run(run[:k]) for k in range(len(run) + 1)]
        normal = "".join(form for _, form in clusters)
        bytes_to = [0, *itertools.accumulate(len(c.encode()) for c in normal)]
        pieces, total = [], 0
        for word, begin, end in self._cut(normal):
            pieces.append((word, begin, end, total))
            total += self.count_word[word]
        counts, known, stored, at, i = [0], {}, (-1, [], []), 0, 0
        for part, form in clusters:
            while i < len(pieces) and pieces[i][1] < at:
                i += 1
            first = i
            while first and (first == i or at - pieces[first][1] < 3):
                first -= 1
            word, begin, end, before = pieces[first] if i else ("", at, at, 0)
            if before > room:
                break
            end = min(end, at)
            long, letters = end - begin > 3, bytes_to[end] - bytes_to[begin]
            if long:
                if stored[0] != first:
                    stored = (first, *self.stems(word, room - before))
                if letters >= len(stored[1]):
                    break
                begin = end - 2
            for k in range(1, len(part) + 1):
                added = form if k == len(part) or form == " " else self.normal(part[:k])
                cut = known.get((normal[begin:at], added))
                if cut is None:
                    cut = known[normal[begin:at], added] = [w for w, _, _ in self._cut(normal[begin:at] + added)]
                if long:
                    more = cut[0][bytes_to[end] - bytes_to[begin] :]
                    counts.append(before + self._goes_on(word, letters, more, *stored[1:]) + sum(map(self.count_word.__getitem__, cut[1:])))
                else:
                    counts.append(before + sum(map(self.count_word.__getitem__, cut)))
            at += len(form)
        return counts

    def _goes_on(self, word: str, letters: int, more: str, last: list[str], count: list[int]) -> int:
        """The count of the first `letters` of a word with others after them, as a whole word, from the counts stored at those letters."""
        if not more:
            return self.ended(word, letters, last, count)
        low = max(0, letters - self.furthest)
        whole = word[low:letters] + more
        return self.ended(whole, len(whole), *self._stems(whole[:-1], last[low : letters + 1], count[low : letters + 1]))


@functools.cache
def joining() -> frozenset[str]:
    """The letters that a letter before them may take in when it is brought into its normal form, beside marks."""
    vowels_and_ends = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    taken = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(map(chr, vowels_and_ends)) | {chr(int(parts[1], 16)) for parts in taken if len(parts) == 2 and parts[0][0] != "<"}


def sure(text: str) -> bool:
    """Whether PIECE cuts a text as the library does."""
    return not UNSURE.search(text) and unicodedata.is_normalized("NFC", text)


@functools.lru_cache(4)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, n_bytes, n_tokens, over_limit and limit_chars.

    Counts are those of the library on whole texts without begin or end tokens; special strings in a
    text are the special tokens. limit_chars is the longest prefix, in code points, within `limit`
    tokens: the whole text if that is not over the limit. A null text counts as empty. Other columns
    are not read; repeated rows and null ids come back as they are.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text_"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = [of.count(t) for t in texts]
            chars = [of.longest_prefix(t, limit) if k > limit else len(t) for t, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(chars, pa.int64())],
                [id_col, "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("limit_chars", T.LongType())]
    return rows.mapInArrow(measure, T.StructType([*rows.schema.fields[:2], *more]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() over the whole documents table."""
    return count_tokens(table(spark, sf_dir, "documents"))
