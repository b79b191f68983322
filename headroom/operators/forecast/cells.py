"""The arithmetic of one recurrent regressor: forward pass, gradient, Adam step. NumPy, used inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GATES = {"gru": 3, "lstm": 4}


@dataclass(frozen=True)
class RecurrentParams:
    """Hyper-parameters of a recurrent regressor and its training; batch size 0 is the full batch."""

    sequence_length: int = 24
    hidden_size: int = 32
    learning_rate: float = 0.01
    epochs: int = 50
    batch_size: int = 256
    num_layers: int = 1
    dropout: float = 0.0
    weight_decay: float = 0.0
    gradient_clip: float = 0.0

    def __post_init__(self):
        for name in ("sequence_length", "hidden_size", "epochs", "num_layers"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if self.batch_size < 0:
            raise ValueError("batch_size must be non-negative")
        if not 0 < self.learning_rate < 1:
            raise ValueError("learning_rate must be greater than 0 and less than 1")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must be in the range [0, 1)")
        if self.weight_decay < 0 or self.gradient_clip < 0:
            raise ValueError("weight_decay and gradient_clip must be non-negative")


def layout(cell: str, inputs: int, params: RecurrentParams) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the weights, in the order they are stored."""
    wide, hidden = GATES[cell] * params.hidden_size, params.hidden_size
    out = []
    for layer in range(params.num_layers):
        width = inputs if layer == 0 else hidden
        out += [
            (f"recurrent.weight_ih_l{layer}", (wide, width)),
            (f"recurrent.weight_hh_l{layer}", (wide, hidden)),
            (f"recurrent.bias_ih_l{layer}", (wide,)),
            (f"recurrent.bias_hh_l{layer}", (wide,)),
        ]
    return [*out, ("output.weight", (1, hidden)), ("output.bias", (1,))]


def unpack(values: np.ndarray, shapes: list[tuple[str, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes:
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape)
        at += size
    return out


def start_weights(cell: str, inputs: int, params: RecurrentParams, seed: int) -> np.ndarray:
    size = sum(int(np.prod(shape)) for _, shape in layout(cell, inputs, params))
    bound = 1 / np.sqrt(params.hidden_size)
    return np.random.default_rng(seed).uniform(-bound, bound, size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gru_step(own, past, h):
    size = h.shape[1]
    reset = _sigmoid(own[:, :size] + past[:, :size])
    keep = _sigmoid(own[:, size : 2 * size] + past[:, size : 2 * size])
    new = np.tanh(own[:, 2 * size :] + reset * past[:, 2 * size :])
    return (1 - keep) * new + keep * h, (reset, keep, new, past[:, 2 * size :])


def _gru_back(dh, h, memory):
    reset, keep, new, past_new = memory
    d_new = dh * (1 - keep) * (1 - new**2)
    d_keep = dh * (h - new) * keep * (1 - keep)
    d_reset = d_new * past_new * reset * (1 - reset)
    return np.hstack([d_reset, d_keep, d_new]), np.hstack([d_reset, d_keep, d_new * reset]), dh * keep


def _lstm_step(own, past, c):
    size = c.shape[1]
    both = own + past
    enter, forget = _sigmoid(both[:, :size]), _sigmoid(both[:, size : 2 * size])
    new, leave = np.tanh(both[:, 2 * size : 3 * size]), _sigmoid(both[:, 3 * size :])
    cell = forget * c + enter * new
    return leave * np.tanh(cell), cell, (enter, forget, new, leave, c, np.tanh(cell))


def _lstm_back(dh, dc, memory):
    enter, forget, new, leave, c, squashed = memory
    dc = dc + dh * leave * (1 - squashed**2)
    gates = [
        dc * new * enter * (1 - enter),
        dc * c * forget * (1 - forget),
        dc * enter * (1 - new**2),
        dh * squashed * leave * (1 - leave),
    ]
    return np.hstack(gates), dc * forget


def forward(cell: str, weights: dict[str, np.ndarray], x: np.ndarray, masks=None):
    """Prediction per sequence of ``x`` (sequences, steps, inputs) and what the backward pass needs."""
    memory, layers = [], sum(name.startswith("recurrent.weight_ih") for name in weights)
    for layer in range(layers):
        w_in, w_past = weights[f"recurrent.weight_ih_l{layer}"], weights[f"recurrent.weight_hh_l{layer}"]
        own = x @ w_in.T + weights[f"recurrent.bias_ih_l{layer}"]
        bias = weights[f"recurrent.bias_hh_l{layer}"]
        h = c = np.zeros((x.shape[0], w_past.shape[1]))
        states, steps = [h], []
        for t in range(x.shape[1]):
            past = h @ w_past.T + bias
            if cell == "gru":
                h, step = _gru_step(own[:, t], past, h)
            else:
                h, c, step = _lstm_step(own[:, t], past, c)
            states.append(h)
            steps.append(step)
        memory.append((x, states, steps))
        x = np.stack(states[1:], axis=1)
        if masks is not None and layer < layers - 1:
            x = x * masks[layer]
    return x[:, -1] @ weights["output.weight"][0] + weights["output.bias"][0], (memory, x)


def gradient(cell: str, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, masks=None):
    """Sum of squared errors over the sequences and its gradient, packed like the weights."""
    predicted, (memory, top) = forward(cell, weights, x, masks)
    error = predicted - y
    out = {name: np.zeros_like(value) for name, value in weights.items()}
    out["output.weight"][0] = 2 * error @ top[:, -1]
    out["output.bias"][0] = 2 * error.sum()
    d_out = np.zeros_like(top)
    d_out[:, -1] = 2 * error[:, None] * weights["output.weight"]
    for layer in reversed(range(len(memory))):
        x_in, states, steps = memory[layer]
        w_in, w_past = weights[f"recurrent.weight_ih_l{layer}"], weights[f"recurrent.weight_hh_l{layer}"]
        dh = dc = np.zeros_like(states[0])
        d_in = np.zeros_like(x_in)
        for t in reversed(range(x_in.shape[1])):
            dh = dh + d_out[:, t]
            if cell == "gru":
                d_own, d_past, kept = _gru_back(dh, states[t], steps[t])
            else:
                d_own, dc = _lstm_back(dh, dc, steps[t])
                d_past, kept = d_own, 0.0
            out[f"recurrent.weight_ih_l{layer}"] += d_own.T @ x_in[:, t]
            out[f"recurrent.weight_hh_l{layer}"] += d_past.T @ states[t]
            out[f"recurrent.bias_ih_l{layer}"] += d_own.sum(axis=0)
            out[f"recurrent.bias_hh_l{layer}"] += d_past.sum(axis=0)
            d_in[:, t] = d_own @ w_in
            dh = d_past @ w_past + kept
        d_out = d_in * masks[layer - 1] if masks is not None and layer > 0 else d_in
    return float(error @ error), np.concatenate([out[name].ravel() for name in weights])


def _mixed(values: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on every bit of the value (splitmix64)."""
    x = values + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(rows: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """A random number per sequence and epoch that depends on nothing else, wherever it is computed."""
    own = np.array([(seed * 1_000_003 + epoch) & (2**64 - 1)], np.uint64)
    return _mixed(_mixed(own) ^ rows.astype(np.uint64))


def batch_count(sequences: int, params: RecurrentParams) -> int:
    return -(-sequences // params.batch_size) if params.batch_size else 1


def batch_of(rows: np.ndarray, sequences: int, params: RecurrentParams, seed: int, epoch: int) -> np.ndarray:
    """Batch of each sequence (named by the row it predicts) in the shuffled epoch.

    An epoch has one batch per ``batch_size`` sequences; each sequence falls into one by chance.
    """
    return _drawn(rows, seed, epoch) % np.uint64(batch_count(sequences, params))


def dropout_masks(params: RecurrentParams, rows: np.ndarray, seed: int, epoch: int):
    """Masks between layers; a single layer has none."""
    if params.num_layers == 1 or params.dropout == 0:
        return None
    keep = 1 - params.dropout
    shape = (len(rows), params.sequence_length, params.hidden_size)
    places = np.arange(shape[1] * shape[2], dtype=np.uint64)
    masks = []
    for layer in range(1, params.num_layers):
        own = _mixed(_drawn(rows, seed, epoch) + np.uint64(layer))[:, None]
        chance = (_mixed(own ^ places) >> np.uint64(11)).astype(float) * 2.0**-53
        masks.append((chance < keep).reshape(shape) / keep)
    return masks


ROWS_COPIED = 4_096  # sequences of a batch copied out of the series at a time
BLOCK_NUMBERS = 1_000_000  # sequences x steps x width x layers looked at together


def summed_gradient(
    cell: str, values: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray, params: RecurrentParams, seed: int, epoch: int
) -> np.ndarray:
    """Gradient summed over the sequences, some at a time, so that memory does not grow with them."""
    weights = unpack(values, layout(cell, x.shape[2], params))
    block = max(1, BLOCK_NUMBERS // (params.sequence_length * params.hidden_size * params.num_layers))
    total = np.zeros(len(values))
    for at in range(0, len(y), block):
        some = slice(at, at + block)
        total += gradient(cell, weights, x[some], y[some], dropout_masks(params, rows[some], seed, epoch))[1]
    return total


def adam_step(values, slope, first, second, step: int, params: RecurrentParams):
    """One Adam update with L2 decay, after clipping the norm of the gradient."""
    if params.gradient_clip > 0:
        slope = slope * min(1.0, params.gradient_clip / (np.linalg.norm(slope) + 1e-6))
    slope = slope + params.weight_decay * values
    first = 0.9 * first + 0.1 * slope
    second = 0.999 * second + 0.001 * slope**2
    rate = params.learning_rate / (1 - 0.9**step)
    return values - rate * first / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), first, second


def windows(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of ``length`` rows (views, nothing is copied) and the first column of the row after each."""
    if len(values) <= length:
        raise ValueError("a series needs more rows than a sequence")
    view = np.lib.stride_tricks.sliding_window_view(values[:-1], length, axis=0)
    return view.transpose(0, 2, 1), values[length:, 0]


def train(cell: str, values: np.ndarray, params: RecurrentParams, seed: int) -> np.ndarray:
    """Weights after all epochs of shuffled mini-batches over one series."""
    x, y = windows(values, params.sequence_length)
    rows = np.arange(params.sequence_length + 1, len(values) + 1)
    weights = start_weights(cell, values.shape[1], params, seed)
    first = second = np.zeros_like(weights)
    step = 0
    for epoch in range(params.epochs):
        batches = batch_of(rows, len(y), params, seed, epoch)
        for batch in range(batch_count(len(y), params)):
            chosen = np.flatnonzero(batches == batch)
            if not len(chosen):
                continue
            step += 1
            slope = np.zeros_like(weights)
            for at in range(0, len(chosen), ROWS_COPIED):
                some = chosen[at : at + ROWS_COPIED]
                slope += summed_gradient(cell, weights, x[some], y[some], rows[some], params, seed, epoch)
            weights, first, second = adam_step(weights, slope / len(chosen), first, second, step, params)
    return weights
