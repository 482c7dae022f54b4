import gc

from barloom.llm import bpe, langid, quality, shared


def test_tidy_frees_before_and_after(monkeypatch):
    order = []
    monkeypatch.setattr(gc, "collect", lambda: order.append("freed"))

    def work(batches):
        order.append("begun")
        yield from batches

    assert list(shared.tidy(work)([1, 2])) == [1, 2]
    assert order == ["freed", "begun", "freed"]


def test_worker_keeps_the_object_but_not_its_bytes():
    class Held:
        pass

    class Context:
        def broadcast(self, value):
            held.value = value
            return held

    class Session:
        sparkContext = Context()

    held = Held()
    get = shared.on_workers(Session(), [1, 2])
    assert get() == [1, 2] and get() is get()
    assert list(held.value) == ["object"]


def test_stages_of_the_pipeline_are_tidied(spark, monkeypatch):
    seen = []
    for module in (langid, quality, bpe):
        monkeypatch.setattr(module, "tidy", lambda work, name=module.__name__: seen.append(name.rpartition(".")[2]) or work)
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    langid.identify(docs, langid.fit(docs))
    quality.score(docs, quality.Model())
    bpe.encode(docs, {bytes([i]): i for i in range(256)}, r"\S+|\s+")
    assert seen == ["langid", "langid", "quality", "bpe"]
