"""A small linear-chain conditional random field over token classes, in numpy.

A token's class stands for its shape, so a sequence is an array of class numbers. The score of a
label is a sum over features of the token's class, of both neighbours' classes and of the file.
"""

from dataclasses import dataclass

import numpy as np

LABELS = 3  # outside, begin, inside
OUTSIDE, BEGIN, INSIDE = range(LABELS)


@dataclass
class Model:
    own: np.ndarray  # class x label
    before: np.ndarray  # class of the token before x label
    after: np.ndarray  # class of the token after x label
    file: np.ndarray  # file class x label
    step: np.ndarray  # label x next label

    def scores(self, classes: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Label scores of each token of (..., length) class arrays; ends see class 0."""
        previous, following = np.zeros_like(classes), np.zeros_like(classes)
        previous[..., 1:] = classes[..., :-1]
        following[..., :-1] = classes[..., 1:]
        return self.own[classes] + self.before[previous] + self.after[following] + self.file[files]

    def slack(self) -> float:
        """A token whose lead of `outside` is larger is outside on every best path: no pair of
        neighbouring labels can make up for it."""
        t = self.step
        return max(
            (t[a, y] + t[y, b]) - (t[a, OUTSIDE] + t[OUTSIDE, b])
            for a in range(LABELS)
            for b in range(LABELS)
            for y in (BEGIN, INSIDE)
        )


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """Best labels of a stretch between two tokens that are outside."""
    best = scores[0] + step[OUTSIDE]
    back = []
    for row in scores[1:]:
        paths = best[:, None] + step
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    label = int((best + step[:, OUTSIDE]).argmax())
    labels = [label]
    for choice in reversed(back):
        label = int(choice[label])
        labels.append(label)
    return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _marginals(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (windows, length, label): token and summed transition marginals."""
    n, length, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for i in range(1, length):
        forward[:, i] = scores[:, i] + _log_sum(forward[:, i - 1, :, None] + step, 1)
    for i in range(length - 2, -1, -1):
        ahead = scores[:, i + 1] + backward[:, i + 1]
        backward[:, i] = _log_sum(step + ahead[:, None, :], 2)
    total = _log_sum(forward[:, -1], 1)
    tokens = np.exp(forward + backward - total[:, None, None])
    steps = np.zeros((LABELS, LABELS))
    for i in range(1, length):
        joint = forward[:, i - 1, :, None] + step + (scores[:, i] + backward[:, i])[:, None, :]
        steps += np.exp(joint - total[:, None, None]).sum(axis=0)
    return tokens, steps


def train(
    classes: np.ndarray,
    labels: np.ndarray,
    files: np.ndarray,
    features: np.ndarray,
    n_files: int,
    rounds: int = 60,
    rate: float = 0.3,
    decay: float = 1e-3,
) -> Model:
    """Maximum likelihood on windows (n, length), by Adam on the whole sample.

    `features` (class x feature) says what the classes have in common.
    """
    k = features.shape[1]
    sizes = [(k, LABELS), (k, LABELS), (k, LABELS), (n_files, LABELS), (LABELS, LABELS)]
    weights = [np.zeros(s) for s in sizes]
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]

    def model() -> Model:
        return Model(*(features @ w for w in weights[:3]), weights[3], weights[4])

    if not len(classes):
        weights[3][:, OUTSIDE] = 10.0
        return model()
    n = len(classes)
    truth = np.eye(LABELS)[labels]
    truth_steps = np.zeros((LABELS, LABELS))
    np.add.at(truth_steps, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    previous, following = np.zeros_like(classes), np.zeros_like(classes)
    previous[:, 1:], following[:, :-1] = classes[:, :-1], classes[:, 1:]
    wide = np.repeat(files[:, None], classes.shape[1], axis=1)

    def gathered(index: np.ndarray, error: np.ndarray, rows: int) -> np.ndarray:
        flat, out = index.ravel(), np.zeros((rows, LABELS))
        for y in range(LABELS):
            out[:, y] = np.bincount(flat, error[..., y].ravel(), minlength=rows)
        return out

    for t in range(1, rounds + 1):
        now = model()
        scores = now.scores(classes, wide)
        tokens, steps = _marginals(scores, now.step)
        error = truth - tokens
        gradients = [features.T @ gathered(x, error, len(features)) for x in (classes, previous, following)]
        gradients += [gathered(wide, error, n_files), truth_steps - steps]
        for i, g in enumerate(gradients):
            g = g / n - decay * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            move = (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
            weights[i] = weights[i] + rate * move
    return model()
