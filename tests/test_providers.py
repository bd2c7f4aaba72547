import io
import json
import pickle
import urllib.error

import pytest

from textquarry.sources import providers as p


class Reply(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def sender(*replies):
    left = list(replies)

    def send(request, timeout):
        send.bodies.append(json.loads(request.data))
        got = left.pop(0)
        if isinstance(got, int):
            raise urllib.error.HTTPError(request.full_url, got, "x", {}, None)
        return Reply(json.dumps(got).encode())

    send.bodies = []
    return send


END = p.Endpoint("http://host.invalid", "k", "m")


def test_retries_only_what_may_pass(monkeypatch):
    waits = []
    assert p.post_json("http://h.invalid", "k", {}, 1, 3, sender(429, 500, {"ok": 1}), waits.append) == {"ok": 1}
    assert waits == [1.0, 2.0]
    with pytest.raises(p.ProviderError):
        p.post_json("http://h.invalid", "k", {}, 1, 3, sender(400), waits.append)
    with pytest.raises(p.ProviderError):
        p.post_json("http://h.invalid", "k", {}, 1, 2, sender(500, 500), waits.append)


def test_embeddings_come_in_order():
    send = sender({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})
    assert p.EmbeddingClient(END, send).embed(["a", "b"]) == [[1.0], [2.0]] and send.bodies[0]["model"] == "m"
    with pytest.raises(p.ProviderError):
        p.EmbeddingClient(END, sender({"data": []})).embed(["a"])
    assert p.EmbeddingClient(END).embed([]) == []


def test_chat_replies():
    send = sender({"choices": [{"message": {"content": " hi "}}]})
    assert p.ChatClient(END, send=send).complete("m2", [{"role": "user", "content": "x"}], {"type": "json_object"}, 0.2) == "hi"
    assert send.bodies[0]["response_format"] == {"type": "json_object"} and send.bodies[0]["temperature"] == 0.2
    for bad in ({}, {"choices": [{"message": {"content": " "}}]}):
        with pytest.raises(p.ProviderError):
            p.ChatClient(END, send=sender(bad)).complete("m", [])
    pickle.loads(pickle.dumps(p.ChatClient(END)))


def test_settings(monkeypatch):
    for name, value in (("BASE_URL", "http://x.invalid/"), ("API_KEY", "your-key"), ("MODEL", "m")):
        monkeypatch.setenv(f"TQT_{name}", value)
    with pytest.raises(p.ProviderError):
        p.Endpoint.from_env("TQT")
    monkeypatch.setenv("TQT_API_KEY", "secret")
    assert p.Endpoint.from_env("TQT").base_url == "http://x.invalid" and p.Endpoint.from_env("TQT").with_model("n").model == "n"


def test_payloads():
    turns = [{"role": "user", "content": " a "}, {"role": "system", "content": "b"}, "x", {"role": "assistant", "content": " "}]
    got = p.clean_payload({"message": "q", "history": turns, "book_id": "b", "mode": "bm25"}, ["b"])
    assert got["history"] == [{"role": "user", "content": "a"}] and got["book_id"] == "b"
    for bad in ({"message": 1}, {"mode": "x"}, {"book_id": "other"}, {"image_data": 3}):
        with pytest.raises(p.ProviderError):
            p.clean_payload(bad, ["b"])
