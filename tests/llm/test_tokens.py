"""Token counts, fertility and packing against the tokenizer libraries and plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orderlake.llm import crc
from orderlake.llm.fertility import Band, fertility, measure
from orderlake.llm.prefix_tokens import PrefixCounter, count_at, longest_prefix, prefix_counts
from orderlake.llm.retrieval_packing import retrieval_packing
from orderlake.llm.word_tokens import WordEncoder
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (0, ""), (1, None), (2, " \n\t "), (3, "one"), (4, "one"), (5, "Ünïcode — 中文 \U0001f600 ǅ"), (6, "a <|endoftext|> b"),
    (7, "x" * 5000), (8, "the cat sat " * 3000), (9, "\x1c\x85\xa0 　 end"), (10, "don't we'll 'tis 's"), (10, "don't we'll 'tis 's"),
    (None, "no id here"), (11, "line one\nline one\n\nline one \nline two\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "en" if r[0] else None, i, "given", -1) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size int, kept string, n_tokens int")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_prefix_counts_of_texts(counter, texts):
    for text in texts.values():
        whole = counter.tokenizer.encode(text, add_special_tokens=False).ids
        assert count_at(counter.table(text), len(text)) == len(whole)


def test_every_prefix(counter):
    rng = random.Random(4)
    parts = ["'re", "<|endoftext|>", " the", "  ", "\n\n", "don't", " 's", *"ab éeE'sx \t\xa0中😀\x1c\x85.,!12　ı"]
    for _ in range(120):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        table = counter.table(text)
        for k in range(len(text) + 1):
            assert count_at(table, len(text), k) == len(counter.tokenizer.encode(text[:k]).ids), text[:k]


def test_longest_prefix(counter):
    text = "The quick brown fox jumps over the lazy dog."
    table = counter.table(text)
    for budget in range(12):
        best = max(k for k in range(len(text) + 1) if len(counter.tokenizer.encode(text[:k]).ids) <= budget)
        assert longest_prefix(table, len(text), budget) == best


def test_prefix_counts_of_odd_rows(odd, counter):
    got = prefix_counts(odd, budget=3).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(counter.tokenizer.encode(text).ids))
        assert count_at(r.prefix_table, len(text)) == r.n_tokens
    assert prefix_counts(odd.where("false")).count() == 0


def _plain(text):
    words, lines, seen = WORD.findall(text), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {k for j in range(len(words) - 2) if triples[tuple(words[j : j + 3])] > 1 for k in range(j, j + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_fertility_of_odd_rows(odd):
    got = fertility(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        want = _plain(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert fertility(odd.where("false")).count() == 0


def test_fertility_measures(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    some = [t for t in list(texts.values())[:60]]
    m = measure(pa.array(some), "piece_bpe_32k.model")
    for i, text in enumerate(some):
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _plain(text)
        tokens = [t for w in WORD.findall(text) for t in model.encode(w)]
        share = np.array(list(Counter(tokens).values())) / max(1, len(tokens))
        assert m["n_pieces"][i] == len(tokens)
        assert m["token_entropy"][i] == pytest.approx(float(-(share * np.log2(share)).sum()) if tokens else 0, abs=1e-9)
        assert m["fallback_share"][i] == pytest.approx(sum(map(model.IsByte, tokens)) / max(1, len(tokens)))


def test_bands_reject(spark):
    good = " ".join(f"word{i} goes{i} along number{i}" for i in range(40))
    rows = [(1, good, "en"), (2, good, "zz"), (3, " ".join(chr(0x1F300 + i) for i in range(80)), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide, never = Band(0, 99, 1, 0), Band(98, 99, 1, 0)
    got = {r.doc_id: r for r in fertility(docs, bands={"en": never, "latin": wide, "other": Band(0, 99, 0.5, 0)}).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [False, True, False]
    assert got[3].fallback_share > 0.5 and not got[3].base_failed


def test_word_encoder(texts):
    words = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    strange = [r[1] or "" for r in ODD] + ["ÀÉ Straße İstanbul ŒUVRE", "é combined", "x<|endoftext|>y", "a\x1cb"]
    for text in [*list(texts.values())[:80], *strange]:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want, text[:50]


def test_crc_parts():
    rng = random.Random(2)
    data = rng.randbytes(5000)
    cuts = [(rng.randint(0, 2000), rng.randint(2000, 5000)) for _ in range(50)] + [(7, 7)]
    a = np.array([zlib.crc32(data[:x]) for x, _ in cuts], np.uint32)
    b = np.array([zlib.crc32(data[:y]) for _, y in cuts], np.uint32)
    got = crc.part(a, b, np.array([y - x for x, y in cuts]))
    assert got.tolist() == [zlib.crc32(data[x:y]) for x, y in cuts]


def _check_packing(pieces, texts):
    """Every id of every row once, sequences without gaps, checksums of the pieces' ids."""
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    for doc_id, text in texts:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        copies = sum(d == doc_id for d, _ in texts)
        spans = Counter((p.start, p.length) for p in by_doc[doc_id])
        assert sum(p.length for p in by_doc[doc_id]) == copies * len(ids)
        if copies == 1:
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
        else:
            assert spans
    return len(by_sequence), sum(p.length for p in pieces)


def test_packing_of_odd_rows(odd):
    _check_packing(retrieval_packing(odd).collect(), ODD)
    assert retrieval_packing(odd.where("false")).count() == 0


def test_packing_fills_windows(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = retrieval_packing(docs, shard_docs=64).collect()
    sequences, tokens = _check_packing(pieces, list(texts.items()))
    assert sequences <= 1.02 * tokens / 2048 + 8
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, retrieval_packing(docs, shard_docs=64).collect()))


def test_packing_finds_neighbours(spark):
    rng = random.Random(5)
    rows, topic = [], {}
    for t in range(6):
        words = [f"{chr(97 + t)}{rng.choice('aeiou')}{rng.choice('lmnrst')}{k}" for k in range(60)]
        for k in range(8):
            topic[len(rows)] = t
            rows.append((len(rows), " ".join(rng.choices(words, k=110))))
    pieces = retrieval_packing(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    together = defaultdict(set)
    for p in pieces:
        together[p.sequence_id].add(topic[p.doc_id])
    assert sum(len(t) for t in together.values()) <= len(together) + 8


def test_bands_part_junk_from_clean_texts(spark):
    """On labelled texts that pass the base rule: most junk goes, clean texts stay, those with keys too."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = fertility(labelled, keep=["doc_id", "quality"]).where("not base_failed").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(kept[0]) <= 0.3 * len(kept[0]) and all(kept[1])


def test_words_with_digits_do_not_count_in_bands():
    text = " ".join(["words", "which", "anybody", "may", "read"] * 12)
    key = f"{text} 0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    m = measure(pa.array([text, key, f"{'1a2b3c4d5e6f7a8b ' * 30}{text}"]), "piece_bpe_32k.model")
    for name in ("chars_per_piece", "chars_per_word", "chars_per_byte"):
        assert m[name][0] == m[name][1] > m[name][2]
    assert m["chars_per_token"][0] > m["chars_per_token"][1]
