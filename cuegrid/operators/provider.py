"""The provider boundary: translation of whatever the memory and checkpoints leave.

A provider maps cue rows to translations.  The built-in one is a dictionary and a
column expression; others plug in as a function over pandas batches of a scene.
Distinct texts are sent once, by their content key.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid import constants as K
from cuegrid.functions import text as T
from cuegrid.operators import memory as M
from cuegrid.operators import quality


class Provider(Protocol):
    """analyze and translate take and return DataFrames keyed by track_id, scene_no and seq; verify adds a verdict."""

    def analyze(self, cues: DataFrame) -> DataFrame: ...

    def translate(self, cues: DataFrame) -> DataFrame: ...

    def verify(self, cues: DataFrame) -> DataFrame: ...


def identity(provider: Provider) -> str:
    """What tells a provider's answers from another's: its `identity`, else its class."""
    return str(getattr(provider, "identity", None) or type(provider).__qualname__)


class DictionaryProvider:
    """Offline: phrases of a fixed dictionary, else the text behind a placeholder."""

    identity = "dictionary"
    #: Whether analyze and verify are these columns, which need no join.
    columns = True

    def analyze(self, cues: DataFrame) -> DataFrame:
        return cues.select("track_id", "seq", F.col("source_text").alias("meaning"))

    def translate(self, cues: DataFrame) -> DataFrame:
        return cues.select("track_id", "seq", T.dictionary_translation(F.col("source_text")).alias("translation"))

    def verify(self, cues: DataFrame) -> DataFrame:
        return cues.select(
            "track_id",
            "seq",
            F.lit("agree").alias("decision"),
            F.lit("none").alias("severity"),
            F.lit(None).cast("string").alias("alternative"),
        )


class ProviderError(Exception):
    """A provider's failure; those of the codes in RETRIED (fixed values) may pass."""

    RETRIED = frozenset(K.RETRIED_CODES)
    #: The caller isn't let in, whatever it asks.
    REFUSED = frozenset((401, 403))

    def __init__(self, code: int, message: str = ""):
        super().__init__(f"{code} {message}".strip())
        self.code = code


class Asker:
    """Calls of a provider: retries after 1, 2, 4 ... times `backoff` seconds, none for a failure whose code can't pass; a batch that fails for good is halved, and each half is tried once more, until the items that fail stand alone, unless any item would meet that failure (REFUSED codes).  rate: calls a second, shared by the threads of a task."""

    def __init__(self, call: Callable, retries: int = 3, fallback: Callable | None = None, backoff: float = 1.0, rate: float | None = None):
        self.call, self.retries, self.fallback, self.backoff, self.rate = call, retries, fallback, backoff, rate
        self.lock, self.next = threading.Lock(), 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lock", "next")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.lock, self.next = threading.Lock(), 0.0

    def _wait(self) -> None:
        if self.rate:
            with self.lock:
                at = max(self.next, time.monotonic())
                self.next = at + 1 / self.rate
            time.sleep(max(0.0, at - time.monotonic()))

    def ask(self, items, tries: int | None = None) -> list:
        """An answer for each item; None (or the fallback's) for those that fail.  items: a pandas Series or DataFrame."""
        tries = tries or self.retries
        for k in range(tries):
            try:
                self._wait()
                made = list(self.call(items))
                if len(made) != len(items):
                    raise ValueError(f"{len(made)} answers to {len(items)} items")
                return made
            except Exception as e:  # noqa: BLE001  a provider may fail in any way
                code = e.code if isinstance(e, ProviderError) else None
                if k < tries - 1 and (code is None or code in ProviderError.RETRIED):
                    time.sleep(self.backoff * 2**k)
                    continue
                if len(items) > 1 and code not in ProviderError.REFUSED:
                    half = len(items) // 2
                    return self.ask(items.iloc[:half], 1) + self.ask(items.iloc[half:], 1)
                break
        return list(self.fallback(items)) if self.fallback else [None] * len(items)


def _as_it_is(texts: pd.Series) -> pd.Series:
    return texts


class BatchProvider(DictionaryProvider):
    """A function of a pandas batch (source_text) to translations, called once for each distinct text, with the retries of an Asker.  What fails alone goes to the fallback (the source text); with None it has no translation."""

    def __init__(
        self,
        call: Callable[[pd.Series], pd.Series],
        retries: int = 3,
        fallback: Callable[[pd.Series], pd.Series] | None = _as_it_is,
        backoff: float = 1.0,
        name: str = "batch",
    ):
        self.asker, self.identity = Asker(call, retries, fallback, backoff), name

    def translate(self, cues: DataFrame) -> DataFrame:
        asker = self.asker

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"content_key": b["content_key"], "translation": asker.ask(b["source_text"])})

        keyed = cues.withColumn("content_key", T.content_key(F.col("source_text")))
        distinct = keyed.groupBy("content_key").agg(F.first("source_text").alias("source_text"))
        made = distinct.mapInPandas(run, "content_key string, translation string")
        return keyed.select("track_id", "seq", "content_key").join(made, "content_key").drop("content_key")


class SceneProvider(DictionaryProvider):
    """Functions of a scene's cues in order, a pandas DataFrame (seq, source_text, meaning, target_text), to an answer for each cue.

    analyze gives meanings, translate translations, verify (decision, severity,
    alternative).  A call holds the cues of one scene, so what a model sees ends where
    the scene does.  Each task has `calls` calls under way at once and starts `rate` a
    second at most; failures are met as an Asker does, within the scene.  A cue whose
    analysis fails means what it says, one whose verification fails is uncertain, and
    one whose translation fails has none unless there is a fallback.
    """

    columns = False

    def __init__(
        self,
        translate: Callable[[pd.DataFrame], list],
        analyze: Callable[[pd.DataFrame], list] | None = None,
        verify: Callable[[pd.DataFrame], list] | None = None,
        retries: int = 3,
        fallback: Callable[[pd.DataFrame], list] | None = None,
        backoff: float = 1.0,
        calls: int = 4,
        rate: float | None = None,
        name: str = "scene",
    ):
        self.identity, self.calls = name, calls
        made = lambda call, instead: Asker(call, retries, instead, backoff, rate) if call else None
        self.askers = {
            "translate": made(translate, fallback),
            "analyze": made(analyze, lambda cues: cues["source_text"]),
            "verify": made(verify, lambda cues: [("uncertain", "none", None)] * len(cues)),
        }

    def _answers(self, cues: DataFrame, what: str, ddl: str, row: Callable) -> DataFrame:
        asker, calls = self.askers[what], self.calls
        have = [F.col(c) if c in cues.columns else F.lit(None).cast("string").alias(c) for c in ("source_text", "meaning", "target_text")]
        # a scene holds max_cues at most
        scenes = cues.groupBy("track_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("seq", *have))).alias("cues"))

        def one(track, cues) -> list[tuple]:
            frame = pd.DataFrame([c if isinstance(c, dict) else c.asDict() for c in cues])
            return [(track, int(seq), *row(answer)) for seq, answer in zip(frame["seq"], asker.ask(frame))]

        names = ["track_id", "seq", *[part.split()[0] for part in ddl.split(", ")]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(calls) as pool:
                for b in batches:
                    made = [r for rows in pool.map(one, b["track_id"], b["cues"]) for r in rows]
                    yield pd.DataFrame(made, columns=names)

        return scenes.select("track_id", "cues").mapInPandas(run, f"track_id string, seq long, {ddl}")

    def analyze(self, cues: DataFrame) -> DataFrame:
        return self._answers(cues, "analyze", "meaning string", lambda a: (a,)) if self.askers["analyze"] else super().analyze(cues)

    def translate(self, cues: DataFrame) -> DataFrame:
        return self._answers(cues, "translate", "translation string", lambda a: (a,))

    def verify(self, cues: DataFrame) -> DataFrame:
        return self._answers(cues, "verify", "decision string, severity string, alternative string", tuple) if self.askers["verify"] else super().verify(cues)


class CachedProvider(DictionaryProvider):
    """Answers of another provider, kept in a table by provider, model, prompt version and text; only what the table lacks is asked for, and what is answered is added."""

    def __init__(self, inner: Provider, path: str, name: str = "provider", model: str = "", version: str = "1"):
        self.inner, self.path, self.parts, self.identity = inner, path, (name, model, version), f"{name}/{model}/{version}"

    def translate(self, cues: DataFrame) -> DataFrame:
        spark = cues.sparkSession
        schema = "content_key string, translation string"
        keyed = cues.withColumn("content_key", T.content_key(*[F.lit(p) for p in self.parts], F.col("source_text")))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        kept = spark.read.schema(schema).parquet(self.path) if at.getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration(),
        ).exists(at) else spark.createDataFrame([], schema)
        # one cue for each text that is asked for
        new = keyed.join(kept, "content_key", "left_anti").groupBy("content_key").agg(
            F.min(F.struct("track_id", "seq", *[c for c in cues.columns if c not in ("track_id", "seq")])).alias("c"),
        ).select("content_key", "c.*")
        made = self.inner.translate(new.drop("content_key")).join(new.select("track_id", "seq", "content_key"), ["track_id", "seq"])
        made.where("translation IS NOT NULL").select("content_key", "translation").write.mode("append").parquet(self.path)
        known = spark.read.schema(schema).parquet(self.path).groupBy("content_key").agg(F.min("translation").alias("translation"))
        return keyed.select("track_id", "seq", "content_key").join(known, "content_key").drop("content_key")


#: Providers by name; others are added with register().
REGISTRY: dict[str, Callable[[], Provider]] = {"dictionary": DictionaryProvider, "mock": DictionaryProvider}


def register(name: str, make: Callable[[], Provider]) -> None:
    REGISTRY[name.strip().lower()] = make


def get_provider(name: str, fallback: bool = True) -> Provider:
    """The provider of that name; for an unknown one the dictionary, or an error without fallback."""
    make = REGISTRY.get(name.strip().lower(), DictionaryProvider if fallback else None)
    if make is None:
        raise ValueError(f"unknown provider: {name}")
    return make()


def with_meanings(cues: DataFrame, provider: Provider) -> DataFrame:
    """Adds the meaning of each cue, as the provider reads its scene."""
    if getattr(provider, "columns", False):
        return cues.withColumn("meaning", F.col("source_text"))
    return cues.join(provider.analyze(cues).select("track_id", "seq", "meaning"), ["track_id", "seq"], "left").withColumn("meaning", F.coalesce("meaning", "source_text"))


def with_verdicts(judged: DataFrame, provider: Provider) -> DataFrame:
    """Adds decision, alternative and escalated: the provider's second opinion on cues that await review, and only on those; it never overrides, a cue it doubts stays in the queue."""
    if getattr(provider, "columns", False):
        return judged.withColumns({"decision": F.lit("agree"), "alternative": F.lit(None).cast("string"), "escalated": F.lit(False)})
    said = quality.verification(judged, provider.verify(judged.where("requires_review")))
    return judged.join(said.select("track_id", "seq", "decision", "alternative", "escalated"), ["track_id", "seq"])


def translate_missing(cues: DataFrame, provider: Provider, memory: DataFrame | None = None, threshold: float = 0.92) -> DataFrame:
    """target_text and its origin (given, memory, provider) of every cue.  The memory is that of earlier runs, so results don't depend on the order of scenes."""
    keys = ["track_id", "seq"]
    todo = cues.where("coalesce(target_text, '') = ''")
    found = M.fuzzy(todo, memory, keys, threshold=threshold).select(*keys, F.col("tm_target")) if memory is not None else todo.select(
        *keys,
        F.lit(None).cast("string").alias("tm_target"),
    ).limit(0)
    made = provider.translate(todo.join(found, keys, "left_anti"))
    out = cues.join(found, keys, "left").join(made, keys, "left")
    given = F.nullif("target_text", F.lit(""))
    return out.withColumns(
        {
            "origin": F.when(given.isNotNull(), "given").when(F.col("tm_target").isNotNull(), "memory").otherwise("provider"),
            "target_text": F.coalesce(given, "tm_target", "translation"),
        },
    ).drop("tm_target", "translation")
