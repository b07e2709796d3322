"""BPE, packing and chat formatting: against the tokenizers library and by round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitals.llm import bpe, chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, length int"
TEXTS = ["", " ", "  ", "a  b", " a", "a ", "\n a\n\n b", "it's we'll  DON'T", "<|endoftext|>x <|endoftext|> y", "aaaaaaaa", "日本語 テスト 🙂🙂", "　x 　 y\x1c z \x85q", "x​y é", "Ⅷ ½ ٣ 12345", "thandnt erething, anoned. " * 40, "tab\there\r\nnow", "word" * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


def test_bpe_is_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    letters = list("abcdefghij éßñ  \n\t.,!?'0123") + ["日", "🙂", " ", "the", "ing", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(letters, 120)) for _ in range(150)]
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(frame(spark, [*enumerate(texts), (999, None)]), PATH).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[999]["n_tokens"] == 0 and got[999]["decoded"] == ""
    assert bpe.bpe_round_trip(frame(spark, []), PATH).count() == 0


def test_pieces_forgotten_by_the_worker_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    a, b = bpe.PairIndexBpe(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(a.encode([t])[0], "<u4").tolist() == b.encode(t, add_special_tokens=False).ids


def test_long_pieces_and_long_texts():
    """Pieces beyond LONG, and a text beyond any chunk, alone and beside short ones."""
    b, library, rng = bpe.PairIndexBpe(PATH), Tokenizer.from_file(PATH), np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    texts = ["x" + long[: bpe.LONG - 1], long, "a" * 3000, "日本語中文" * 300, "the " + long[:400] + " end", " ".join(long[k : k + 5] for k in range(0, 100_000, 5)) * 10]
    for t, ids in zip(texts, b.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_split_characters_decode_to_the_replacement_character():
    b, library = bpe.PairIndexBpe(PATH), Tokenizer.from_file(PATH)
    ids = library.encode("🙂日", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert b.decode(np.array(ids[cut:], "<u4").tobytes()).decode() == library.decode(ids[cut:], skip_special_tokens=False)


def test_pieces_make_up_each_document(spark):
    library = Tokenizer.from_file(PATH)
    docs = [*enumerate(TEXTS), (50, None), (None, "no id"), (3, "again")]
    packed = bpe.pack_powers_of_two(frame(spark, docs), PATH, 256)
    rows = packed.collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and 1 << r["bucket"] == r["length"] <= 256 and r["offset"] == 0 for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for k, t in [(5, TEXTS[5]), (14, TEXTS[14]), (16, TEXTS[16]), (50, "")]:
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 1]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and own[0]["doc_tokens"] == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert len({r["sequence_id"] >> 52 for r in rows}) == len({r["bucket"] for r in rows})
    cut = bpe.pack_powers_of_two(frame(spark, docs).repartition(7), PATH, 256, with_ids=False)
    assert sorted(map(str, cut.collect())) == sorted(map(str, packed.drop("ids").collect()))
    assert bpe.pack_powers_of_two(frame(spark, []), PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        bpe.pack_powers_of_two(frame(spark, []), PATH, 100)


# ---- chat


def said(template, messages, **names):
    return list(chat.Template(template, chat.CONTROLS).render(messages))


def test_template_language():
    m = [{"role": "user", "text": "Hi "}, {"role": "assistant", "text": "yo"}]
    t = "{# note #}{% set a = 'x' + 'y' %}{% for m in messages %}{% if loop.first and not loop.last %}{{ a }}{% elif m['role'] == 'assistant' or false %}{% generation %}{{ m.text | upper }}{% endgeneration %}{% else %}-{% endif %}{{ loop.index }}{% endfor %}"
    assert said(t, m) == [("xy", False), ("1", False), ("YO", True), ("2", False)]


def test_constants_are_folded():
    t = chat.Template("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% elif not false %}d{% endif %}{{ 1 }}")
    assert t.tree == [("text", "abCd1")]


@pytest.mark.parametrize("bad", ["{{ x }}", "{{ messages.__class__() }}", "{% for %}", "{% if 1 %}", "{{ 'a' | system }}", "{% import os %}", "{{ 1 + }}", "{% endif %}", "{{ open('f') }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        list(chat.Template(bad).render([]))


def test_escape_is_reversible():
    e = chat.Escaper(chat.CONTROLS)
    rng = np.random.default_rng(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<", "\\", "[", "/", "s>", "INST]", "a", " ", "[ROLE]", "\\\\"]
    for _ in range(500):
        t = "".join(rng.choice(parts, 12))
        assert e.undo(e(t)) == t and not any(c in e(t) for c in chat.CONTROLS)


TURNS = "conv_id long, turn long, role string, text string, piece string"


def test_read_back_is_what_was_said(spark):
    rows = [(1, 1, "assistant", "[/INST] </s>"), (1, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "é🙂"), (2, 2, "assistant", "b"), (3, 0, "[/ROLE]", "x\n"), (None, 5, None, "t"), (4, None, "user", "z"), (4, 0, "assistant", ""), (4, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "p") for r in rows], TURNS)
    got = {r["conv_id"]: r for r in chat.read_back(df).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        learnt = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), turns, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    pieces = chat.format_conversations(df).orderBy("conv_id", "piece").collect()
    assert {c: sum(len(p["text"]) for p in pieces if p["conv_id"] == c) for c in got} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.read_back(df.limit(0)).count() == 0


def test_plain_words_are_encoded_without_the_pattern():
    """Words of a to z are one token each after a blank, so the pattern sees the other words only; ids are the library's."""
    encoder, library, seen = bpe.PairIndexBpe(PATH), Tokenizer.from_file(PATH), []
    find = encoder.find
    encoder.find = lambda text: seen.append(text) or find(text)
    texts = ["it Plain words, don't naïve x1 " + "q" * 300 + " words ﬁne other\nend 's", "so Plain  words"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(seen[0].split()) == sorted(["words,", "don't", "naïve", "x1", "ﬁne", "other", "end", "'s"])
