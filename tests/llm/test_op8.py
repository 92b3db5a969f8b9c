"""Units beside stops."""
import numpy as np


def test_stops_after_other_characters_are_encoded_as_the_library_does():
    import public_tokenizers
    from logloom.llm.op8_token_files import UnitEncoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["word. word, word", "x), y. z!. w", "a½. b², c", "é, ñ. ü", "one\ntwo. three", ". a", "a , b", "(. b", None, "", "a, b. c, d"]
    encoder = UnitEncoder(path, "<u2")
    want = [np.asarray(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]
