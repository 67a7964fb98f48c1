"""Operators that ask something outside: a name server, a web service or a trained model.

Each asks through a function that the stage's options may give, so that jobs without a network can bring their own.
"""

from __future__ import annotations

import json
import re
import uuid
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frame import Effect, Frame
from ..plans.rules import Rule, RuleError
from ..sources.getters import get_mapping
from .base import effect, operator, reject, source
from .lookups import text_of

#: Answers that a worker remembers at a time, and for how many seconds.
REMEMBERED, FRESH = 1 << 16, 300.0
_answers: dict[tuple[str, str], tuple[float, str | None]] = {}
_pool: list[ThreadPoolExecutor] = []


def dns(name: str, timeout: float = 0.5) -> str | None:
    """Address of a host, or None. A lookup that takes longer than the timeout counts as none."""
    import socket

    if not _pool:
        _pool.append(ThreadPoolExecutor(16))
    try:
        return _pool[0].submit(socket.gethostbyname, name).result(timeout)
    except (OSError, UnicodeError, TimeoutError):
        return None


def remembered(service: str, name: str, ask: Callable[[str], str | None], most: int, fresh: float) -> str | None:
    """The answer of a service, from what this worker remembers if that isn't too old."""
    now, at = time.monotonic(), (service, name)
    known = _answers.get(at)
    if known is not None and now - known[0] < fresh:
        return known[1]
    if len(_answers) >= most:  # the oldest go; the table is in the order in which answers came
        for old in list(_answers)[: most // 4 + 1]:
            del _answers[old]
    _answers.pop(at, None)
    answer = ask(name)
    _answers[at] = now, answer
    return answer


@operator("domain_resolver")
def domain_resolver(rule: Rule, frame: Frame, options: dict) -> Effect:
    """The address of a host or of a URL's host. Each worker remembers up to ``max_cached_domains`` answers, also failures, for ``cache_seconds``;
    failures write nothing."""
    reject(rule, "source_fields", "target_field")
    from ..functions.domains import host

    resolve: Callable[[str], str | None] = options.get("resolver") or (lambda n, limit=float(options.get("timeout", 0.5)): dns(n, limit))
    most, fresh = int(options.get("max_cached_domains", REMEMBERED)), float(options.get("cache_seconds", FRESH))
    service = uuid.uuid4().hex  # of this compiled rule

    @F.pandas_udf("string")
    def look(names: pd.Series) -> pd.Series:
        return names.map(lambda n: remembered(service, n, resolve, most, fresh) if n else None)

    path = rule.sources[0]
    return effect(rule, frame, [(rule.target, look(host(source(frame, path).cast("string"))))], miss=False)


def resolve_distinct(df: DataFrame, column: str, target: str, resolver: Callable[[str], str | None]) -> DataFrame:
    """Asks once for each different value of the whole table and joins the answers: for slow services and large tables."""
    look = F.pandas_udf(lambda s: s.map(resolver), "string")
    answers = df.select(F.col(column).alias("__k")).where("__k is not null").distinct().select("__k", look("__k").alias(target))
    return df.join(answers, df[column] == answers["__k"], "left").drop("__k")


def http_call(request: dict) -> tuple[int, str]:
    import requests

    answer = requests.request(request["method"], request["url"], timeout=request.get("timeout", 2), **{k: request[k] for k in ("json", "data", "params", "headers", "auth", "verify") if request.get(k) is not None})
    return answer.status_code, answer.text


@operator("requester")
def requester(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Calls a web service with fields in its URL and body, once for each event; the answer is written as text or, if JSON, by a mapping. With
    ``shared_answers`` of the stage's options, equal requests that only read are sent once in a batch. A task that runs again calls again."""
    reject(rule, "url", "method")
    call = options.get("caller") or http_call
    spec = {k: rule.options[k] for k in ("url", "method", "json", "data", "params", "headers", "auth", "timeout", "verify") if k in rule.options}
    names = list(dict.fromkeys(re.findall(r"\$\{([^}]+)\}", json.dumps(spec))))
    targets = rule.option("target_field_mapping") or {}
    shared = bool(options.get("shared_answers")) and str(spec["method"]).upper() in ("GET", "HEAD")

    @F.pandas_udf("struct<ok:boolean,body:string>")
    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}

        def one(values: tuple) -> tuple:
            if any(v is None or v == "" for v in values):
                return None, None
            if not shared or values not in known:
                text = json.dumps(spec)
                for n, v in zip(names, values):
                    text = text.replace("${" + n + "}", json.dumps(str(v))[1:-1])
                try:
                    status, body = call(json.loads(text))
                    known[values] = (status < 400, body)
                except (OSError, ValueError):  # what a client raises for the net and for addresses
                    known[values] = (False, None)
            return known[values]

        return pd.DataFrame([one(tuple(r)) for r in batch.itertuples(index=False)], columns=["ok", "body"])

    given = F.struct(*(text_of(frame, n).alias(f"v{i}") for i, n in enumerate(names))) if names else F.struct(F.lit("x").alias("v0"))
    answer = ask(given)
    empty = F.lit(False)
    for n in names:
        empty = empty | (text_of(frame, n) == "")
    body = F.when(answer["ok"], answer["body"])
    writes = [(rule.target, body)] if rule.target else []
    writes += [(t, F.get_json_object(body, "$." + s)) for s, t in targets.items()]
    if not writes:
        raise RuleError("a rule of requester needs target_field or target_field_mapping")
    return effect(rule, frame, writes, sources=names, warn=[(~answer["ok"] | empty, rule.failure_tags)])


def normal_command(value):
    """Command lines as sorted tokens: without quotation marks, in lower case, without long tokens and long hexadecimal ones."""
    plain = F.lower(F.regexp_replace(value, r"[\"'^`]", ""))
    tokens = F.regexp_extract_all(plain, F.lit(r"(?U)(\w+)"), F.lit(1))
    kept = F.filter(tokens, lambda t: (F.length(t) <= 30) & ~t.rlike(r"^(0x)?[0-9a-f]{8,}$"))
    return F.array_join(F.array_sort(kept), ",")


class Linear:
    """A linear model on TF-IDF of tokens, for many texts at once."""

    def __init__(self, model: dict) -> None:
        self.tokens = pd.Index(list(model["idf"]))
        self.idf = np.array([model["idf"][t] for t in self.tokens], float)
        self.weight = np.array([model["weights"].get(t, 0.0) for t in self.tokens], float)
        self.bias = float(model.get("bias", 0.0))

    def confidence(self, row: np.ndarray, token: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """From (row, token, how often), the probability of each row, rounded to thousandths."""
        at = self.tokens.get_indexer(token)
        known = at >= 0
        x = count[known] * self.idf[at[known]]
        size = np.sqrt(np.bincount(row[known], x * x, rows))
        z = np.bincount(row[known], x * self.weight[at[known]], rows) / np.where(size > 0, size, 1.0) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 3)


def counted(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, how often) of texts whose tokens are joined by commas."""
    tokens = texts.str.split(",").explode()
    found = pd.DataFrame({"row": tokens.index, "token": tokens.to_numpy()}).value_counts().reset_index()
    return found["row"].to_numpy(np.int64), found["token"].to_numpy(object), found["count"].to_numpy(float)


@operator("amides")
def amides(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Scores command lines by a linear model on TF-IDF of their tokens, and names the rules that they resemble most.

    The model is a mapping or a JSON or YAML file: ``misuse`` with ``idf`` and ``weights`` by token, ``bias`` and
    ``threshold``; ``attribution`` with such a model for each rule name.
    """
    reject(rule, "source_fields")
    model = options.get("model") or options.get("models_path")
    if isinstance(model, str):
        model = get_mapping(model)
    if not model:
        raise RuleError("amides needs a model")
    top, threshold = int(options.get("num_rule_attributions", 10)), float(options.get("decision_threshold", model["misuse"].get("threshold", 0.5)))
    misuse, names = Linear(model["misuse"]), sorted(model.get("attribution", {}))
    each = [Linear(model["attribution"][n]) for n in names]

    @F.pandas_udf("struct<confidence:double,attributions:array<struct<rule:string,confidence:double>>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        texts = texts.reset_index(drop=True)
        some = texts.notna() & (texts != "")
        row, token, count = counted(texts[some])
        sure = misuse.confidence(row, token, count, len(texts))
        high = np.flatnonzero(some & (sure >= threshold))
        found: list[list[dict] | None] = [None] * len(texts)
        if names and len(high):
            here = np.isin(row, high)
            own = np.searchsorted(high, row[here])
            line = np.stack([m.confidence(own, token[here], count[here], len(high)) for m in each], axis=1)
            best = np.argsort(-line, axis=1, kind="stable")[:, :top]  # names are sorted, so ties go by name
            for i, r in enumerate(high.tolist()):
                found[r] = [{"rule": names[k], "confidence": float(line[i, k])} for k in best[i]]
        return pd.DataFrame({"confidence": pd.Series(sure).where(some), "attributions": pd.Series(found, dtype=object)})

    answer = score(normal_command(text_of(frame, rule.sources[0])))
    base = rule.target or "amides"
    return effect(rule, frame, [(f"{base}.confidence", answer["confidence"]), (f"{base}.attributions", answer["attributions"])])
