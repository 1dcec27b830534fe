"""Models: small driver-side values that operators ship to tasks.

A model has ``n`` states, a start vector ``pi`` and transition matrices ``a`` of shape (classes, n, n); most
models have one class. Emissions are tables (:class:`DiscreteHmm`) or densities (:class:`ContinuousHmm`).
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np

#: A probability under this counts as zero, and rows may miss 1 by this.
EPS = 1e-8
DNA = ("a", "c", "g", "t")
KINDS = ("normal", "normal_right", "normal_left", "uniform", "multinormal")


def integer_range(a: int, b: int) -> tuple[int, ...]:
    """The alphabet a, ..., b - 1."""
    return tuple(range(a, b))


@dataclass
class Hmm:
    pi: np.ndarray
    a: np.ndarray
    #: Label of each state, if states are labelled.
    labels: list[str] | None = None
    #: States whose emissions training leaves alone.
    fixed: frozenset[int] = frozenset()
    prior: float | None = None
    name: str = ""

    def __post_init__(self) -> None:
        self.pi = np.asarray(self.pi, float)
        self.a = np.asarray(self.a, float)
        if self.a.ndim == 2:
            self.a = self.a[None]
        if self.a.shape[1:] != (self.n, self.n):
            raise ValueError("a must be n x n, or classes x n x n")

    @property
    def n(self) -> int:
        return len(self.pi)

    @property
    def silent(self) -> list[int]:
        return []

    def silent_order(self) -> list[int]:
        """Silent states, each after those that lead to it."""
        left, done = set(self.silent), []
        links = (self.a > 0).any(0)
        while left:
            ready = sorted(s for s in left if not any(links[q, s] for q in left))
            if not ready:
                raise ValueError("silent states form a cycle")
            done += ready
            left -= set(ready)
        return done

    def copy(self) -> Hmm:
        return copy.deepcopy(self)

    def normalised(self) -> Hmm:
        """Start vector, transition rows and emissions scaled to sum 1; rows of zeros stay."""
        out = self.copy()
        out.pi = _scaled(out.pi)
        out.a = _scaled(out.a)
        return out

    def check(self) -> list[str]:
        """What is wrong with the model, an empty list if nothing is."""
        bad = [] if abs(self.pi.sum() - 1) < EPS else ["pi does not sum to 1"]
        sums = self.a.sum(2)
        bad += [f"row {i} of class {c} sums to {s:g}" for (c, i), s in np.ndenumerate(sums) if abs(s) > EPS and abs(s - 1) > EPS]
        return bad

    def set_start(self, state: int, p: float, keep: bool = True) -> None:
        """Sets a start probability; the others share the rest in proportion."""
        others = np.arange(self.n) != state
        if keep and self.pi[others].sum() > 0:
            self.pi[others] *= (1 - p) / self.pi[others].sum()
        self.pi[state] = p

    def set_transition(self, src: int, dst: int, p: float, cls: int = 0) -> None:
        self.a[cls, src, dst] = p

    def with_noise(self, level: float, seed: int = 0) -> Hmm:
        """Start and transition chances, and emission tables, each times 1 + ``level`` * u with u from -1 to 1, scaled again; zeros stay."""
        rng, out = np.random.default_rng(seed), self.copy()
        out.pi, out.a = (x * (1 + level * rng.uniform(-1, 1, x.shape)) for x in (out.pi, out.a))
        if isinstance(out, DiscreteHmm):
            out.b = [x * (1 + level * rng.uniform(-1, 1, x.shape)) for x in out.b]
        return out.normalised()

    def of_class(self, cls: int) -> Hmm:
        """The model of one transition class."""
        out = self.copy()
        out.a = out.a[cls : cls + 1]
        return out

    def with_duration(self, state: int, times: int) -> Hmm:
        """``state`` replaced by a chain of ``times`` copies: entries reach the first, exits leave the last."""
        n, extra = self.n, times - 1
        old = list(range(n)) + [state] * extra
        out = self.copy()
        out.pi = np.append(self.pi, np.zeros(extra))
        out.a = np.zeros((len(self.a), n + extra, n + extra))
        out.a[:, :n, :n] = self.a
        if extra > 0:
            chain = [state, *range(n, n + extra)]
            out.a[:, chain[-1], :n] = self.a[:, state]
            out.a[:, state] = 0
            for x, y in zip(chain[:-1], chain[1:], strict=True):
                out.a[:, x, y] = 1
        if self.labels is not None:
            out.labels = [self.labels[i] for i in old]
        out._copy_emissions(old)
        return out

    def _copy_emissions(self, old: list[int]) -> None:
        raise NotImplementedError


def _scaled(x: np.ndarray) -> np.ndarray:
    total = x.sum(-1, keepdims=True)
    return np.divide(x, total, out=np.array(x, float), where=total > 0)


@dataclass
class DiscreteHmm(Hmm):
    #: Emissions of each state: m ** (order + 1) entries, the history most significant; all zero: a silent state.
    b: list[np.ndarray] = field(default_factory=list)
    alphabet: tuple = ()
    #: Groups of states that share emissions, and named background distributions.
    ties: list[list[int]] = field(default_factory=list)
    backgrounds: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.b = [np.asarray(x, float) for x in self.b]
        for x in self.b:
            if len(x) != self.m ** (round(math.log(len(x), self.m)) if self.m > 1 else 1):
                raise ValueError("emission tables must have a power of m entries")

    @property
    def m(self) -> int:
        return len(self.alphabet)

    @property
    def silent(self) -> list[int]:
        return [i for i, x in enumerate(self.b) if not x.any()]

    def order(self, state: int) -> int:
        return round(math.log(len(self.b[state]), self.m)) - 1 if self.m > 1 else 0

    def normalised(self) -> DiscreteHmm:
        out = super().normalised()
        out.b = [_scaled(x.reshape(-1, self.m)).reshape(-1) for x in out.b]
        return out

    def check(self) -> list[str]:
        bad = super().check()
        for i, x in enumerate(self.b):
            if x.any() and (np.abs(x.reshape(-1, self.m).sum(1) - 1) > EPS).any():
                bad.append(f"emissions of state {i} do not sum to 1")
        return bad

    def _copy_emissions(self, old: list[int]) -> None:
        self.b = [self.b[i].copy() for i in old]

    def set_emission(self, state: int, p: list[float]) -> None:
        """A new emission table; it must have a power of m entries, and be all zero for a silent state."""
        table = np.asarray(p, float)
        if len(table) != self.m ** max(1, round(math.log(len(table), self.m)) if self.m > 1 else 1):
            raise ValueError("emission tables must have a power of m entries")
        self.b[state] = table

    def tied(self) -> DiscreteHmm:
        """Tied states given the mean of their emissions; silent members and those of another order stay."""
        out = self.copy()
        for group in self.ties:
            live = [i for i in group if self.b[i].any() and self.order(i) == self.order(group[0])]
            if live:
                mean = np.mean([self.b[i] for i in live], axis=0)
                for i in live:
                    out.b[i] = mean.copy()
        return out

    def with_background(self, mix: dict[int, tuple[str, float]]) -> DiscreteHmm:
        """Emissions mixed with backgrounds: ``mix`` maps a state to a background's name and weight."""
        out = self.copy()
        for i, (name, w) in mix.items():
            if len(self.backgrounds[name]) != len(self.b[i]):
                raise ValueError("state and background differ in order")
            out.b[i] = (1 - w) * self.b[i] + w * np.asarray(self.backgrounds[name], float)
        return out


def model_of_sequence(obs: list[int], alphabet: tuple) -> DiscreteHmm:
    """The left-right model that emits exactly ``obs``."""
    n, m = len(obs), len(alphabet)
    a = np.zeros((n, n))
    a[np.arange(n - 1), np.arange(1, n)] = 1
    return DiscreteHmm(pi=np.eye(n)[0], a=a, b=list(np.eye(m)[obs]), alphabet=alphabet)


def models_of_sequences(rows: list[list[int]]) -> list[DiscreteHmm]:
    """A left-right model for each sequence, over the symbols 0 to the largest of all; an empty sequence has none."""
    alphabet = integer_range(0, max((x for r in rows for x in r), default=0) + 1)
    return [model_of_sequence(r, alphabet) for r in rows if r]


@dataclass
class Component:
    """A weighted density: second moments are variances; truncated kinds are cut at ``lo`` or ``hi``."""

    kind: str = "normal"
    weight: float = 1.0
    mean: float | np.ndarray = 0.0
    var: float | np.ndarray = 1.0
    lo: float | None = None
    hi: float | None = None
    fixed: bool = False

    def density(self, x: np.ndarray) -> np.ndarray:
        """Without the weight; ``x`` has shape (..., d) for multinormal."""
        if self.kind == "uniform":
            return ((x >= self.lo) & (x <= self.hi)) / (self.hi - self.lo)
        if self.kind == "multinormal":
            mean, cov = np.asarray(self.mean, float), np.asarray(self.var, float)
            off = x - mean
            q = np.einsum("...i,ij,...j->...", off, np.linalg.inv(cov), off)
            return np.exp(-0.5 * q) / math.sqrt((2 * math.pi) ** len(mean) * np.linalg.det(cov))
        p = np.exp(-((x - self.mean) ** 2) / (2 * self.var)) / math.sqrt(2 * math.pi * self.var)
        if self.kind in ("normal_right", "normal_left"):
            right = self.kind == "normal_right"
            # the tail's mass, counted from its far end; a tail too far out to have any has density 0
            mass = phi(((self.mean - self.lo) if right else (self.hi - self.mean)) / math.sqrt(self.var))
            return np.where(x < self.lo if right else x > self.hi, 0.0, p / mass) if mass > 0 else np.zeros_like(p)
        return p

    def cumulative(self, x: float) -> float:
        if self.kind == "uniform":
            return min(1.0, max(0.0, (x - self.lo) / (self.hi - self.lo)))
        sd = math.sqrt(self.var)
        at = phi((x - self.mean) / sd)
        if self.kind == "normal_right":
            mass = phi((self.mean - self.lo) / sd)
            return min(1.0, max(0.0, 1 - phi((self.mean - x) / sd) / mass)) if mass > 0 else float(x >= self.lo)
        if self.kind == "normal_left":
            mass = phi((self.hi - self.mean) / sd)
            return min(1.0, at / mass) if mass > 0 else float(x >= self.hi)
        return at


def phi(z: float) -> float:
    """The standard normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def inverse_phi(p: float) -> float:
    """The standard normal quantile: the z with phi(z) = p."""
    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


@dataclass
class ContinuousHmm(Hmm):
    components: list[list[Component]] = field(default_factory=list)

    @property
    def dim(self) -> int:
        c = self.components[0][0]
        return len(np.atleast_1d(c.mean)) if c.kind == "multinormal" else 1

    def _copy_emissions(self, old: list[int]) -> None:
        self.components = [copy.deepcopy(self.components[i]) for i in old]

    def set_weight(self, state: int, component: int, weight: float) -> None:
        """A component's weight; the others that aren't fixed share the rest in proportion."""
        comps = self.components[state]
        free = [c for k, c in enumerate(comps) if k != component and not c.fixed]
        rest = 1 - weight - sum(c.weight for k, c in enumerate(comps) if k != component and c.fixed)
        total = sum(c.weight for c in free)
        if rest < -EPS or rest > EPS and not total:
            raise ValueError("the other components can't take up the rest")
        for c in free:
            c.weight *= max(0.0, rest) / total if total else 0.0
        comps[component].weight = weight

    def density(self, state: int, x: np.ndarray) -> np.ndarray:
        return sum(c.weight * c.density(x) for c in self.components[state])

    def cumulative(self, state: int, x: float) -> float:
        return sum(c.weight * c.cumulative(x) for c in self.components[state])

    def interval(self, state: int) -> tuple[int, int]:
        """Whole numbers around three standard deviations of the state's components."""
        lo = min(c.mean - 3 * math.sqrt(c.var) for c in self.components[state])
        hi = max(c.mean + 3 * math.sqrt(c.var) for c in self.components[state])
        return math.floor(lo), math.ceil(hi)

    def free_parameters(self) -> int:
        """Counted from the zero pattern: probabilities less one for each distribution, and the densities' own."""
        count = max(0, int((self.pi > 0).sum()) - 1) + int(np.maximum((self.a > 0).sum(2) - 1, 0).sum())
        for i, comps in enumerate(self.components):
            if i in self.fixed:
                continue
            count += len(comps) - 1
            for c in comps:
                d = self.dim
                count += 0 if c.fixed else 2 if c.kind != "multinormal" else d + d * (d + 1) // 2
        return count


def parameter_distance(x: DiscreteHmm, y: DiscreteHmm) -> float:
    """Root of the mean squared difference of start, transition and emission probabilities."""
    parts = [x.pi - y.pi, (x.a - y.a).reshape(-1), *[p - q for p, q in zip(x.b, y.b, strict=True)]]
    return float(np.sqrt(np.mean(np.concatenate(parts) ** 2)))
