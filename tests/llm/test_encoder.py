"""The encoder works in its task's own thread, and patches what its cache lacks."""

from wickframe.llm.tokens import Encoder, default_path


def test_one_thread_and_equal_ids_with_a_small_cache(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    texts = ["a b a c b zz9 q, a\nb a qq a", "x  y", "", "é b\tc a a, b. a", "n1 n2 n3 n1 n2\nn4 n4 n5"]
    for cache in (0, 3, 1000):
        encoder = Encoder(default_path(), cache)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    import os

    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
