"""Straightforward versions of the operators, for comparison."""

from __future__ import annotations

import math

import numpy as np


def sweep(perf_pred, cost_pred, perf, cost, fallback="first", tie="index"):
    """``[(threshold, cost, performance)]`` by trying every budget on every item."""
    perf_pred, cost_pred = np.asarray(perf_pred, float), np.asarray(cost_pred, float)
    perf, cost = np.asarray(perf, float), np.asarray(cost, float)
    thresholds = sorted({c for c in cost_pred.ravel() if not math.isnan(c)})
    out = []
    for c in thresholds:
        picks = []
        for i in range(len(perf)):
            options = [j for j in range(perf.shape[1]) if cost_pred[i, j] <= c]
            if not options:
                cheapest = [j for j in range(perf.shape[1]) if not math.isnan(cost_pred[i, j])]
                if fallback == "first" or not cheapest:
                    picks.append(0)
                else:
                    picks.append(min(cheapest, key=lambda j: (cost_pred[i, j], j)))
                continue

            def rank(j):
                p = math.inf if math.isnan(perf_pred[i, j]) else perf_pred[i, j]
                return (-p, cost_pred[i, j] if tie == "cheapest" else 0, j)

            picks.append(min(options, key=rank))
        rows = np.arange(len(perf))
        out.append((c, cost[rows, picks].mean(), perf[rows, picks].mean()))
    return out


def frontier(points):
    """``[(cost, performance)]`` of the points that beat every cheaper one."""
    out, best = [], -math.inf
    for c, p in sorted(points, key=lambda x: (x[0], -x[1])):
        if p > best:
            out.append((c, p))
            best = p
    return out


def metrics(points, accuracies, costs):
    front = frontier(points)
    xs, ys = [c for c, _ in front], [p for _, p in front]
    area = sum((b - a) * (p + q) / 2 for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]))
    nauc = area / (xs[-1] - xs[0]) if len(xs) > 1 and xs[-1] > xs[0] else math.nan
    ps = max(ys) if ys else math.nan
    best = int(np.argmax(accuracies))
    reached = [c for c, p in front if p >= accuracies[best]]
    qnc = reached[0] / costs[best] if reached and costs[best] > 0 else math.inf
    return nauc, ps, qnc
