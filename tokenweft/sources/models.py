"""A model's files from a folder: configuration, weights in the safetensors layout, vocabulary; and its encoder in numpy.

The folder is read once, from the driver's disk or through Spark's readers, checked against `MAX_BYTES` and broadcast; arrays are views
of the bytes, so a Python worker holds the weights once. Texts are encoded in blocks of `BLOCK`, sorted by length, padded to the longest.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from tokenweft.operators.encode import MARKERS, MAX_DOC, MAX_QUERY, PROJECTION_DIM, ModelEncoder, architecture, model_encoder

MAX_BYTES = 1 << 30
BLOCK = 32
UNKNOWN = "[UNK]"
#: The parts of a model folder, the tensor with the trained projection, and the element types of the weights' layout.
CONFIG, WEIGHTS, TOKENIZER, VOCABULARY = "config.json", "model.safetensors", "tokenizer.json", "vocab.txt"
PROJECTION = "linear.weight"
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1"}
#: Names of a layer's parts in the weights of each architecture, in the order q, k, v, out, norm, up, down, norm.
_BERT = ("encoder.layer.{}.", ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense", "attention.output.LayerNorm", "intermediate.dense", "output.dense", "output.LayerNorm"))
LAYERS = {
    "bert": _BERT,
    "roberta": _BERT,
    "distilbert": ("transformer.layer.{}.", ("attention.q_lin", "attention.k_lin", "attention.v_lin", "attention.out_lin", "sa_layer_norm", "ffn.lin1", "ffn.lin2", "output_layer_norm")),
    "albert": ("encoder.albert_layer_groups.0.albert_layers.0.", ("attention.query", "attention.key", "attention.value", "attention.dense", "attention.LayerNorm", "ffn", "ffn_output", "full_layer_layer_norm")),
}


def read_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> dict[str, bytes]:
    """The parts that are there, by name; refused beyond `most` bytes before any content is read."""
    names = (CONFIG, WEIGHTS, TOKENIZER, VOCABULARY)
    if os.path.isdir(path):
        sizes = {n: os.path.getsize(os.path.join(path, n)) for n in names if os.path.exists(os.path.join(path, n))}
        rows = None
    else:
        rows = spark.read.format("binaryFile").load(path)
        sizes = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in rows.select("path", "length").toLocalIterator()}
        sizes = {n: v for n, v in sizes.items() if n in names}
    if sum(sizes.values()) > most:
        raise ValueError(f"the model's files have {sum(sizes.values())} bytes, over the bound of {most}")
    if missing := {CONFIG, WEIGHTS} - set(sizes):
        raise ValueError(f"no {sorted(missing)} in {path}")
    if rows is None:
        return {n: open(os.path.join(path, n), "rb").read() for n in sizes}  # noqa: SIM115
    found = rows.where(rows["path"].rlike("/(" + "|".join(sizes) + ")$")).select("path", "content").toLocalIterator()
    return {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in found}


def read_tensors(data: bytes) -> dict[str, np.ndarray]:
    """Named arrays: eight bytes of header length, a JSON header with type, shape and place, then the elements."""
    size = int.from_bytes(data[:8], "little")
    try:
        about = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise ValueError(f"no readable header of weights: {e}") from e
    out = {}
    for name, what in about.items():
        if name == "__metadata__":
            continue
        start, end = (8 + size + x for x in what["data_offsets"])
        if what["dtype"] == "BF16":
            array = (np.frombuffer(data[start:end], "<u2").astype("<u4") << 16).view("<f4")
        elif what["dtype"] in TYPES:
            array = np.frombuffer(data, TYPES[what["dtype"]], (end - start) // np.dtype(TYPES[what["dtype"]]).itemsize, start)
        else:
            raise ValueError(f"element type {what['dtype']} of {name} is not supported")
        out[name] = array.reshape(what["shape"])
    return out


def write_tensors(tensors: dict[str, np.ndarray]) -> bytes:
    """The same layout from 32-bit arrays."""
    about, at = {}, 0
    for name, array in tensors.items():
        about[name] = {"dtype": "F32", "shape": list(array.shape), "data_offsets": [at, at + 4 * array.size]}
        at += 4 * array.size
    head = json.dumps(about).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(np.ascontiguousarray(a, "<f4").tobytes() for a in tensors.values())


def read_tokenizer(files: dict[str, bytes]):
    """The folder's tokenizer, or one for lower-cased word pieces around its vocabulary."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, processors

    if TOKENIZER in files:
        return Tokenizer.from_str(files[TOKENIZER].decode())
    if VOCABULARY not in files:
        raise ValueError(f"neither {TOKENIZER} nor {VOCABULARY} among the model's files")
    vocab = {word: i for i, word in enumerate(files[VOCABULARY].decode().splitlines())}
    out = Tokenizer(models.WordPiece(vocab, unk_token=UNKNOWN))
    out.normalizer, out.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    out.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[(t, vocab[t]) for t in ("[CLS]", "[SEP]")])
    out.add_special_tokens([t for t in ("[CLS]", "[SEP]", "[MASK]", UNKNOWN) if t in vocab])
    return out


def _activation(name: str) -> Callable[[np.ndarray], np.ndarray]:
    if name == "relu":
        return lambda x: np.maximum(x, 0)
    if name in ("gelu_new", "gelu_pytorch_tanh"):
        return lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))
    if name != "gelu":
        raise ValueError(f"activation {name!r} is not supported")

    def gelu(x: np.ndarray) -> np.ndarray:
        """x times the normal distribution, by the rational approximation of erf with error 1.5e-7."""
        z = np.abs(x) / np.sqrt(2)
        t = 1 / (1 + 0.3275911 * z)
        tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
        return x * 0.5 * (1 + np.sign(x) * (1 - tail))

    return gelu


class Network:
    """The base encoder of a model: ids (texts x length) and their mask to hidden states."""

    def __init__(self, config: dict, tensors: dict[str, np.ndarray], base: str):
        word = next((n for n in tensors if n.endswith("embeddings.word_embeddings.weight")), None)
        if word is None:
            raise ValueError("the weights hold no word embeddings")
        prefix = word[: -len("embeddings.word_embeddings.weight")]
        self.tensors = {n[len(prefix) :]: a for n, a in tensors.items() if n.startswith(prefix)}
        either = lambda *names: next((config[n] for n in names if n in config), None)
        self.heads, self.layers = either("num_attention_heads", "n_heads"), either("num_hidden_layers", "n_layers")
        self.eps = config.get("layer_norm_eps", 1e-12)
        self.act = _activation(either("hidden_act", "activation") or "gelu")
        self.hidden = either("hidden_size", "dim")
        self.shift = config.get("pad_token_id", 1) + 1 if base == "roberta" else 0
        self.pattern, self.parts = LAYERS[base]

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.tensors[f"{name}.weight"].T.astype(np.float32, copy=False) + self.tensors[f"{name}.bias"]

    def _norm(self, name: str, x: np.ndarray) -> np.ndarray:
        mean = x.mean(-1, keepdims=True)
        scaled = (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + self.eps)
        return scaled * self.tensors[f"{name}.weight"] + self.tensors[f"{name}.bias"]

    def __call__(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        n, length = ids.shape
        x = self.tensors["embeddings.word_embeddings.weight"][ids].astype(np.float32)
        x = x + self.tensors["embeddings.position_embeddings.weight"][np.arange(length) + self.shift]
        if "embeddings.token_type_embeddings.weight" in self.tensors:
            x = x + self.tensors["embeddings.token_type_embeddings.weight"][0]
        x = self._norm("embeddings.LayerNorm", x)
        if "encoder.embedding_hidden_mapping_in.weight" in self.tensors:
            x = self._linear("encoder.embedding_hidden_mapping_in", x)
        blocked = np.where(real, 0, -1e9).astype(np.float32)[:, None, None, :]
        for i in range(self.layers):
            q, k, v, out, first, up, down, last = (self.pattern.format(i) + part for part in self.parts)
            parted = lambda name, x=x: self._linear(name, x).reshape(n, length, self.heads, -1).transpose(0, 2, 1, 3)
            keys = parted(k)
            scores = parted(q) @ keys.transpose(0, 1, 3, 2) / np.sqrt(keys.shape[-1]) + blocked
            scores = np.exp(scores - scores.max(-1, keepdims=True))
            mixed = (scores / scores.sum(-1, keepdims=True)) @ parted(v)
            x = self._norm(first, x + self._linear(out, mixed.transpose(0, 2, 1, 3).reshape(n, length, -1)))
            x = self._norm(last, x + self._linear(down, self.act(self._linear(up, x))))
        return x


def _inference(files: dict[str, bytes], base: str) -> Callable[[list[list[str]]], list[np.ndarray]]:
    """Token lists to hidden states; a token outside the vocabulary is the unknown one."""
    network = Network(json.loads(files[CONFIG]), read_tensors(files[WEIGHTS]), base)
    ids = read_tokenizer(files).get_vocab(with_added_tokens=True)
    unknown = next((ids[t] for t in (UNKNOWN, "<unk>") if t in ids), 0)

    def run(texts: list[list[str]]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty((0, network.hidden))] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        for start in range(0, len(order), BLOCK):
            block = order[start : start + BLOCK]
            found = np.zeros((len(block), len(texts[block[-1]])), np.int64)
            real = np.zeros(found.shape, bool)
            for row, i in enumerate(block):
                found[row, : len(texts[i])] = [ids.get(t, unknown) for t in texts[i]]
                real[row, : len(texts[i])] = True
            states = network(found, real)
            for row, i in enumerate(block):
                out[i] = states[row, : len(texts[i])]
        return out

    return run


def _tokens(files: dict[str, bytes]) -> Callable[[str, str | None, int], list[str]]:
    """(text, role, limit) to tokens: the role's marker and a blank stand before the text; special tokens count."""
    tokenizer = read_tokenizer(files)
    names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}

    def run(text: str | None, role: str | None, limit: int) -> list[str]:
        tokenizer.enable_truncation(limit)
        marker = MARKERS[role]
        return [names.get(i, UNKNOWN) for i in tokenizer.encode(f"{marker} {text or ''}" if marker else text or "").ids]

    return run


def load_model(spark: SparkSession, path: str, max_query: int = MAX_QUERY, max_doc: int = MAX_DOC, dim: int | None = PROJECTION_DIM, base: str | None = None) -> ModelEncoder:
    """An encoder from a model's folder: its trained projection where the weights hold one, else a seeded random one to `dim` (none: hidden states)."""
    files = read_files(spark, path)
    config = json.loads(files[CONFIG])
    base = architecture(config, base)
    if base not in LAYERS:
        raise ValueError(f"unsupported base architecture {base!r}")
    tensors = read_tensors(files[WEIGHTS])
    hidden = Network(config, tensors, base).hidden
    read_tokenizer(files)
    trained = tensors[PROJECTION].T.tolist() if PROJECTION in tensors else None
    sent = spark.sparkContext.broadcast(files)
    return model_encoder(
        lambda: _inference(sent.value, base), hidden, hidden if dim is None else dim, trained,
        tokenizer=lambda: _tokens(sent.value), max_query=max_query, max_doc=max_doc,
    )
