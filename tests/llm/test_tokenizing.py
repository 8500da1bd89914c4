"""The chunk encoder against the library's own ids of whole texts."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import tokenizing

ODD = [
    None, "", " ", "\n", "a", "a  b", " a", "b ", "\x00a b", "x\n\ny \nz", " q r", "a\tb", "one, two.\nThree!!! four", "<|endoftext|>a, b<|endoftext|>. c's, d'LL! x<|endoftext|>***",
    "A <|ENDOFTEXT|> b", "İstanbul Σας J̌ Ǆ.", "Été!!! naïve, 12,5 3. ñ.; x͏́.", "ŉ ǰ ǅ ß ﬁ", "word" * 40 + ".", "中文, 日本語。 ok", "\U0001f600 a. b\U0001f600",
]
KINDS = [("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")]


def whole(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "space"), KINDS)
def test_chunks_give_the_ids_of_whole_texts(name, space):  # with so small a cache generations change with each call
    encoder = tokenizing.ChunkEncoder(tokenizing.tokenizer_path(name), 3)
    assert encoder.rule == space
    for texts in (ODD, ODD[::-1], ODD * 2):
        assert encoder.encode(pa.array(texts, pa.string())) == whole(encoder, texts)
    assert encoder.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize(("name", "space"), KINDS)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("ab CD.,'!\n 1é&ŉ́<|>"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_text(name, space, texts):
    encoder = tokenizing.encoder(tokenizing.tokenizer_path(name))
    assert encoder.encode(pa.array(texts, pa.string())) == whole(encoder, texts)


@pytest.mark.parametrize("change", ["normalizer", "pattern", "added", "dropout"])
def test_other_tokenizers_encode_texts_whole(change, tmp_path):
    told = json.loads(Path(tokenizing.tokenizer_path("byte_bpe_50k.json")).read_text())
    if change == "normalizer":
        told["normalizer"] = {"type": "Lowercase"}
    elif change == "pattern":
        told["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "added":
        told["added_tokens"].append({"id": 50257, "content": "two, words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    else:
        told["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "other.json").write_text(json.dumps(told))
    encoder = tokenizing.ChunkEncoder(str(tmp_path / "other.json"))
    texts = [*ODD, "say two, words and Two Words"]
    assert encoder.rule is None
    assert encoder.encode(pa.array(texts, pa.string())) == whole(encoder, texts)


def test_blocks_hold_every_row_once():
    texts = pa.array(["x" * n for n in (0, 5, 50, 3, 0, 7)] + [None])
    cuts = list(tokenizing.text_blocks(texts, 10))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(7))
