"""Cross-tokenizer alignment against whole-text encoding and plain counting."""

from __future__ import annotations

import gc
import hashlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from commentlab.llm import alignment, queries
from tests.conftest import SF_SMALL

PARTS = st.one_of(
    st.sampled_from(["the", " of", "<s>", "<|endoftext|>", "<0x0A>", "\n", "\n\n", "\r\n", "  ", ");\r", "it's", "é", "日本", "😀", "\x00", " ", "\x1c", " 12", "\t"]),
    st.text(alphabet=st.characters(codec="utf-8"), max_size=6),
)


class Plain:
    """The contract, text by text, with both libraries on whole texts."""

    def __init__(self):
        a, b = alignment.default_paths()
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        self.alphabet = alignment.byte_alphabet()
        self.cache = {}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, self.b.id_to_piece(i)) for i in self.b.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        return a, b

    def groups(self, text):
        if not text:
            return []
        a, b = self.tokens(text)
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return []
        out, i, j, at_a, at_b, first = [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            at_a += len(a[i][1])
            i += 1
            while at_b < at_a:
                at_b += len(b[j][1])
                j += 1
            if at_a == at_b:
                out.append(([x for x, _ in a[first[0] : i]], [x for x, _ in b[first[1] : j]]))
                first = (i, j)
        return out

    def answer(self, rows):
        links = []
        for _, text in rows:
            links.append(Counter((x, y) for a, b in self.groups(text) for x in a for y in b))
        count = Counter(pair for own in links for pair in own)
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        out = []
        for (doc_id, text), own in zip(rows, links, strict=True):
            groups = self.groups(text)
            digest = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((
                doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
                sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                hashlib.sha256(digest.encode()).hexdigest() if groups else "",
            ))
        return sorted(out, key=repr)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.default_paths())


@given(st.lists(PARTS, max_size=20).map("".join))
@settings(max_examples=400, deadline=None)
def test_cuts_give_the_groups_of_whole_texts(plain, aligner, text):
    cuts = alignment.units(" " + text) if text else []
    found = aligner.of(set(cuts))
    digest = "" if any(found[c] is None for c in cuts) else ";".join(found[c].digest for c in cuts)
    assert digest == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain.groups(text))


def test_slices():
    assert [x.tolist() for x in alignment.group_slices([2, 2, 3], [1, 3, 1, 2])] == [[4, 7], [2, 3], [2, 4]]
    assert [x.tolist() for x in alignment.group_slices([], [])] == [[], [], []]


def test_big_groups_are_counted_by_pairs(plain, monkeypatch):
    texts = ["日本 the it's naïve 😀😀 x", "tokenization of unbelievable words", "the the"]
    for bound in (0, 3, 1 << 12):
        monkeypatch.setattr(alignment, "BIG_GROUP", bound)
        aligner = alignment.Aligner(alignment.default_paths())
        for t in texts:
            cuts = alignment.units(" " + t)
            found = aligner.of(set(cuts))
            links = Counter()
            for c in cuts:
                x = found[c]
                codes = alignment.np.frombuffer(x.codes, dtype="i8").tolist()
                times = alignment.np.frombuffer(x.times, dtype="i8").tolist() if x.times else [1] * len(codes)
                for code, n in zip(codes, times, strict=True):
                    links[divmod(code, aligner.b.size)] += n
                assert sum(times) == x.counts[3]
            assert links == Counter((x, y) for a, b in plain.groups(t) for x in a for y in b)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40000))
EDGE = [
    (1, None), (2, ""), (3, " \n "), (None, "no id"), (5, "tie of ties"), (5, "tie of ties"), (6, LONG), (7, "it holds ▁ itself"),
    (8, "x" * 3000), (12, "the " + "abcde" * 60_000 + " 日" * 3000), (9, "<|endoftext|> <s>"), (10, "日本語 the 日本 the"), (11, "\n\nthe\nthe"),
]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_awkward_rows(spark, plain, small_blocks, monkeypatch):
    rows = EDGE + [(100 + i, f"the {i % 7} words of {'the ' * (i % 5)}text{i % 3}.") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 3, [1]) for i, t in rows], "doc_id bigint, text string, block string, n_a int, codes array<int>")
    if small_blocks:  # every task makes many blocks
        run = alignment._align_texts

        def cut_small(*args):
            inner = run(*args)

            def task(batches):
                alignment.BLOCK_TEXTS, alignment.ROWS_AT_ONCE, alignment.STRUNG, alignment.HELD_CUTS = 4, 2, 5, 10
                yield from inner(batches)

            return task

        monkeypatch.setattr(alignment, "_align_texts", cut_small)
    got = sorted(map(tuple, alignment.align(docs.repartition(3)).collect()), key=repr)
    assert got == plain.answer(rows)
    assert alignment.align(docs.limit(0)).collect() == []


def test_query(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_end_index_alignment"](spark, SF_SMALL).collect()), key=repr) == plain.answer(docs)


def test_cuts_are_aligned_together_as_one_by_one_and_long_ones_are_not_kept():
    aligner = alignment.aligner_of(alignment.default_paths())
    cuts = {" plain", " wörd", "\n", " " * 9, " x" + "y" * 300, " " + "▁" * 3, " 12", " 345678", " zz" * 3, " \U0001f600", " " + "a" * 150}
    found = aligner.of(set(cuts))
    for c in cuts:
        alone = aligner._single(c)
        assert (found[c] is None) == (alone is None)
        if alone is not None:
            assert found[c][:2] == alone[:2] and len(found[c].codes) // 8 == (alone.counts[3] if found[c].times is None else len(found[c].times) // 8)
    assert {c for c in cuts if c in aligner.young} == {c for c in cuts if len(c) <= alignment.LONG_CUT}
    assert aligner.of(set(cuts)) == found


@pytest.mark.parametrize("numbers", [[], [5], [3, 1, 3, 2, 1, 3], [7] * 9, [-(2**62), 2**62, 0]])
def test_different_numbers(numbers):
    numbers = alignment.np.array(numbers, dtype=alignment.np.int64)
    got, times = alignment._different(numbers)
    want, often = alignment.np.unique(numbers, return_counts=True)
    assert got.tolist() == want.tolist() and times.tolist() == often.tolist()


@pytest.mark.parametrize("places", [[0], [3, 4, 260], [0, 70_000], [65_535, 65_536, 200_000]])
@pytest.mark.parametrize("often", [1, 255, 256, 70_000])
def test_places_of_cuts_are_packed_in_as_few_bytes_as_they_need(places, often):
    places = alignment.np.array(places)
    repeats = alignment.np.arange(len(places)) + often
    packed = alignment._pack(places, repeats)
    assert [x.tolist() for x in alignment._unpack(packed)] == [places.tolist(), repeats.tolist()]
    assert len(packed) <= 2 + 8 * len(places) and (often > 200 or places[-1] > 260 or len(packed) <= 2 + 3 * len(places))


def test_a_block_asks_for_each_cut_once_and_the_collector_runs_again(monkeypatch):
    asked, of = [], alignment.Aligner.of

    def spy(self, cuts):
        assert not gc.isenabled()
        asked.extend(cuts)
        return of(self, cuts)

    monkeypatch.setattr(alignment.Aligner, "of", spy)
    monkeypatch.setattr(alignment, "ROWS_AT_ONCE", 2)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    kinds = {"doc_id": pa.int64(), "groups_sha256": pa.string(), "codes": pa.list_(pa.int64()), "docs": pa.list_(pa.int64())}
    names = ["doc_id", "block", "cuts", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "docs", "sizes", "pairs", "times"]
    kinds |= dict.fromkeys(["cuts", "sizes", "pairs", "times"], pa.binary())
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
    texts = ["the cat and the dog", "the dog", None, "the cat\nsat", "and a dog", "", "the cat"]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = [r for b in alignment._align_texts(alignment.default_paths(), schema)(iter([rows])) for r in b.to_pylist()]
    assert len(asked) == len(set(asked)) and gc.isenabled()
    assert [r["doc_id"] for r in out] == [*range(len(texts)), None] and out[-1]["sizes"] is not None
