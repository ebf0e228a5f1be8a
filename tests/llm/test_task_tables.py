"""What a task builds is gone when it ends, without a search for cycles."""

import gc

import public_tokenizers
import pyarrow as pa

from tallycell.llm import bpe_codec


def test_a_codec_ends_with_its_task():
    def standing():
        return sum(isinstance(x, bpe_codec.Codec) for x in gc.get_objects())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], ["doc_id", "text"])
    gc.collect()
    gc.disable()
    try:
        before = standing()
        out = list(bpe_codec._digest(public_tokenizers.path("word_bpe_49k.json"))(iter([batch])))
        assert sum(x.num_rows for x in out) == 2
        assert standing() == before
    finally:
        gc.enable()
