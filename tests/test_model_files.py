"""Model folders: layout of the weights, tokens, and the numpy encoder against one written token by token."""

import json
import math

import numpy as np
import pytest

from tokenweft import api
from tokenweft.operators import encode
from tokenweft.sources import models

HIDDEN, HEADS, INNER = 8, 2, 12
VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[", "]", "q", "d", "cat", "##s", "sat", ".", "mat"]
CONFIG = {"model_type": "bert", "hidden_size": HIDDEN, "num_attention_heads": HEADS, "num_hidden_layers": 2, "hidden_act": "gelu"}


def weights(prefix="bert.", trained=True, seed=3):
    rng = np.random.default_rng(seed)
    shapes = {"embeddings.word_embeddings.weight": (len(VOCAB), HIDDEN), "embeddings.position_embeddings.weight": (64, HIDDEN), "embeddings.token_type_embeddings.weight": (2, HIDDEN)}
    names = ["embeddings.LayerNorm"]
    for i in range(2):
        pattern, parts = models.LAYERS["bert"]
        q, k, v, out, first, up, down, last = (pattern.format(i) + part for part in parts)
        shapes |= {f"{n}.weight": (HIDDEN, HIDDEN) for n in (q, k, v, out)} | {f"{up}.weight": (INNER, HIDDEN), f"{down}.weight": (HIDDEN, INNER)}
        shapes |= {f"{n}.bias": (HIDDEN,) for n in (q, k, v, out, down)} | {f"{up}.bias": (INNER,)}
        names += [first, last]
    shapes |= {f"{n}.{kind}": (HIDDEN,) for n in names for kind in ("weight", "bias")}
    out = {prefix + n: rng.normal(size=s).astype(np.float32) for n, s in shapes.items()}
    return out | ({"linear.weight": rng.normal(size=(4, HIDDEN)).astype(np.float32)} if trained else {})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    (tmp_path / "vocab.txt").write_text("\n".join(VOCAB))
    (tmp_path / "model.safetensors").write_bytes(models.write_tensors(weights()))
    return tmp_path


def slow_states(words):
    """Hidden states by loops over tokens and heads."""
    w = {n.removeprefix("bert."): a.astype(float) for n, a in weights().items()}

    def norm(name, x):
        return (x - x.mean()) / math.sqrt(x.var() + 1e-12) * w[name + ".weight"] + w[name + ".bias"]

    def linear(name, x):
        return w[name + ".weight"] @ x + w[name + ".bias"]

    ids = [VOCAB.index(t) if t in VOCAB else 1 for t in words]
    xs = [norm("embeddings.LayerNorm", w["embeddings.word_embeddings.weight"][t] + w["embeddings.position_embeddings.weight"][i] + w["embeddings.token_type_embeddings.weight"][0]) for i, t in enumerate(ids)]
    for layer in range(2):
        p = f"encoder.layer.{layer}."
        q, k, v = ([linear(f"{p}attention.self.{n}", x) for x in xs] for n in ("query", "key", "value"))
        size, after = HIDDEN // HEADS, []
        for i, x in enumerate(xs):
            mixed = np.zeros(HIDDEN)
            for h in range(HEADS):
                at = slice(h * size, (h + 1) * size)
                e = np.array([math.exp(q[i][at] @ k[j][at] / math.sqrt(size)) for j in range(len(xs))])
                mixed[at] = sum(e[j] / e.sum() * v[j][at] for j in range(len(xs)))
            x = norm(f"{p}attention.output.LayerNorm", x + linear(f"{p}attention.output.dense", mixed))
            inner = np.array([z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in linear(f"{p}intermediate.dense", x)])
            after.append(norm(f"{p}output.LayerNorm", x + linear(f"{p}output.dense", inner)))
        xs = after
    return np.array(xs)


def vectors(words):
    found = slow_states(words) @ weights()["linear.weight"].T
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def test_tensors_round_trip():
    tensors = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.zeros(0, np.float32)}
    back = models.read_tensors(models.write_tensors(tensors))
    assert all(np.array_equal(back[n], a) for n, a in tensors.items())
    half = json.dumps({"h": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    assert models.read_tensors(len(half).to_bytes(8, "little") + half + b"\x80\x3f\x00\xc0")["h"].tolist() == [1.0, -2.0]
    with pytest.raises(ValueError, match="header"):
        models.read_tensors(b"\x04" + bytes(7) + b"nope")


def test_documents_and_queries_of_a_model(spark, folder):
    encoder = api.load_encoder(spark, str(folder), max_query=9, max_doc=60)
    assert (encoder.dim, encoder.hidden_dim) == (4, HIDDEN)
    docs = spark.createDataFrame([(1, "Cats sat."), (2, None), (3, "zebra " * 300)], "doc_id long, text string")
    got = {}
    for r in encode.encode_documents(docs, encoder).orderBy("doc_id", "tok_pos").collect():
        got.setdefault(r["doc_id"], []).append((r["token"], r["embedding"]))
    assert [t for t, _ in got[1]] == ["[CLS]", "[", "d", "]", "cat", "##s", "sat", ".", "[SEP]"]
    assert [t for t, _ in got[2]] == ["[CLS]", "[", "d", "]", "[SEP]"]
    assert len(got[3]) == 60 and got[3][-1][0] == "[SEP]" and {t for t, _ in got[3][4:-1]} == {"[UNK]"}
    for i in (1, 2):
        assert np.allclose([v for _, v in got[i]], vectors([t for t, _ in got[i]]), atol=1e-4)
    queries = spark.createDataFrame([(7, "cat"), (8, "cats sat cats sat")], "query_id long, text string")
    rows = encode.encode_queries(queries, encoder).orderBy("query_id", "q_pos").collect()
    mine = [r for r in rows if r["query_id"] == 7]
    assert [r["token"] for r in mine] == ["[CLS]", "[", "q", "]", "cat", "[SEP]", "[MASK]"]
    assert [r["weight"] for r in mine] == [1.0] * 6 + [3.0]
    assert np.allclose(mine[-1]["embedding"], vectors(["[CLS]", "[MASK]", "[SEP]"])[1], atol=1e-4)
    assert np.allclose([r["embedding"] for r in mine[:-1]], vectors([r["token"] for r in mine[:-1]]), atol=1e-4)
    full = [r["token"] for r in rows if r["query_id"] == 8]
    assert len(full) == 9 and full[-1] == "[SEP]"


def test_read_by_spark_and_refusals(spark, folder):
    files = models.read_files(spark, f"file:{folder}")
    assert files == models.read_files(spark, str(folder)) and set(files) == {"config.json", "model.safetensors", "vocab.txt"}
    with pytest.raises(ValueError, match="bound"):
        models.read_files(spark, str(folder), most=10)
    (folder / "config.json").write_text('{"model_type": "odd"}')
    with pytest.raises(ValueError, match="odd"):
        models.load_model(spark, str(folder))
    (folder / "config.json").unlink()
    with pytest.raises(ValueError, match="config.json"):
        models.load_model(spark, str(folder))


def test_padding_does_not_change_states_and_untrained_models_get_a_projection(spark, folder):
    (folder / "model.safetensors").write_bytes(models.write_tensors(weights(prefix="", trained=False)))
    assert models.load_model(spark, str(folder), dim=3).dim == 3 and models.load_model(spark, str(folder), dim=None).dim == HIDDEN
    run = models._inference(models.read_files(spark, str(folder)), "bert")
    texts = [["[CLS]", "cat", "[SEP]"], [], ["[CLS]", *["mat", "sat"] * 20, "odd", "[SEP]"]]
    for text, states in zip(texts, run(texts), strict=True):
        assert states.shape == (len(text), HIDDEN)
        if text:
            assert np.allclose(states, slow_states(text), atol=1e-4)
