"""Texts beyond the size that is encoded at once give the library's ids."""

import pyarrow as pa
import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import bpe, packing  # noqa: E402


@pytest.mark.parametrize("long_bytes", [packing.LONG_BYTES, 3000])
def test_ids_of_long_texts(monkeypatch, long_bytes):
    monkeypatch.setattr(packing, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(packing, "CHUNK", 700)
    monkeypatch.setattr(packing, "OVERLAP", 40)
    model = bpe.load(bpe.default_path())
    texts = ["short", None, "", "déjà vu, <|endoftext|> it's  so\n\n" * 300, "x" * 5000, "one two " * 900]
    ids, at = packing._encoded(model, pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == model.whole.encode(text or "", add_special_tokens=False).ids
