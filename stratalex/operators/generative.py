"""Generative models by name: what a model makes, the grid it is tried over, and its own test; for DataFrames and for SQL.

A model is a class with parameters. Registered models are written to by SQL through
the table functions ``generated`` and ``model_grid``, so a query makes texts in parallel, a row
of seeds a text; ``quick_score`` judges their profiles.
"""

from __future__ import annotations

import json
import random
from abc import ABC, abstractmethod
from itertools import product

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from stratalex.operators import stats
from stratalex.session import Tables, materialize


class GenerativeModel(ABC):
    """Makes words from a seed; ``params`` are those of the grid."""

    #: Parameters and the values that are tried, coarse to fine.
    GRID: dict[str, tuple] = {}

    def __init__(self, **params) -> None:
        unknown = params.keys() - self.GRID.keys()
        if unknown:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        self.params = {k: v[0] for k, v in self.GRID.items()} | params

    @abstractmethod
    def words(self, rng: random.Random, n: int) -> list[str]:
        """``n`` words, by ``rng`` alone."""

    def critical(self, profile: dict[str, float]) -> bool:
        """The model's own test of a profile (h1, h2, h3, exponent, ttr); passes if there is none."""
        return True

    @classmethod
    def grid(cls) -> list[dict]:
        return [dict(zip(cls.GRID, values)) for values in product(*cls.GRID.values())]


class Slots(GenerativeModel):
    """Words of a beginning, a middle and an end, each perhaps left out."""

    GRID = {"begin": (0.9, 0.5), "end": (0.9, 0.5), "size": (10, 30)}
    #: What the slots hold.
    BEGIN, MIDDLE, END = (
        "qo o ch sh d s k t p f y l r ok ot qok qot cho sho do so ko to po fo yk yt lk rk dch".split(),
        "ke te e ee eo ai ol al od ka ta che she ko to ekee ete eke ede aiin okee otee kee tee ockh octh ol or".split(),
        "y dy n in iin l r ol al ar or am an s dal dar dam ain aiin eey edy eody ody oly aly ary ory ys dys".split(),
    )

    def words(self, rng: random.Random, n: int) -> list[str]:
        p, k = self.params, int(self.params["size"])
        pick = lambda slot, share: rng.choice(slot[:k]) if rng.random() < share else ""
        return [pick(self.BEGIN, p["begin"]) + rng.choice(self.MIDDLE[:k]) + pick(self.END, p["end"]) for _ in range(n)]

    def critical(self, profile: dict[str, float]) -> bool:
        return profile["h2"] < profile["h1"]


class Shuffled(GenerativeModel):
    """Letters at even odds, words of a length drawn around a mean: what any structure has to differ from."""

    GRID = {"mean": (5, 3, 8), "letters": (20, 12)}

    def words(self, rng: random.Random, n: int) -> list[str]:
        sign = "abcdefghijklmnopqrstuvwxyz"[: int(self.params["letters"])]
        return ["".join(rng.choices(sign, k=max(1, round(rng.gauss(self.params["mean"], 1.5))))) for _ in range(n)]


class Repeating(GenerativeModel):
    """Words copied from those before with a letter changed at times."""

    GRID = {"change": (0.3, 0.1, 0.6), "back": (20, 100)}

    def words(self, rng: random.Random, n: int) -> list[str]:
        out = ["daiin", "chol", "shey", "qokedy"][:n]
        while len(out) < n:
            w = rng.choice(out[-int(self.params["back"]) :])
            if rng.random() < self.params["change"]:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice("acdehiklnoqrsty") + w[at + rng.randint(0, 1) :]
            out.append(w)
        return out

    def critical(self, profile: dict[str, float]) -> bool:
        return profile["ttr"] < 0.5


#: The models that every session knows.
MODELS: dict[str, type[GenerativeModel]] = {"slots": Slots, "shuffled": Shuffled, "repeating": Repeating}


def register_model(name: str, model: type[GenerativeModel]) -> None:
    """Make a model known by ``name``; sessions see it after ``register_sql``."""
    if not name.isidentifier():
        raise ValueError(f"no name for a model: {name!r}")
    MODELS[name] = model


def register_sql(spark: SparkSession) -> None:
    """Table functions of a session, over the models known now.

    ``model_grid(name)``: (params), a row for each setting. ``generated(name, params,
    seed, n)``: (pos, word); an unknown name or parameter is an error when the query is
    analysed. ``ngrams(text, k)``: as many columns w1, w2, ... as ``k`` says. ``quick_score(h2, ttr,
    exponent, h2_0, ttr_0, exponent_0)``: the distance of a profile from a target, and whether all three are near.
    """
    models = dict(MODELS)

    class Generated:
        @staticmethod
        def analyze(name: AnalyzeArgument, params: AnalyzeArgument, seed: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
            if name.isConstantExpression:
                if name.value not in models:
                    raise ValueError(f"no model {name.value!r}; there are {sorted(models)}")
                if params.isConstantExpression and params.value:
                    models[name.value](**json.loads(params.value))
            return AnalyzeResult(schema=StructType().add("pos", IntegerType()).add("word", StringType()))

        def eval(self, name: str, params: str, seed: int, n: int):
            model = models[name](**json.loads(params or "{}"))
            for pos, word in enumerate(model.words(random.Random(f"{name}|{params or '{}'}|{seed}"), int(n or 0))):
                yield pos, word

    class Grid:
        def eval(self, name: str):
            for params in models[name].grid():
                yield (json.dumps(params),)

    class Grams:
        @staticmethod
        def analyze(text: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
            if not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1:
                raise ValueError("ngrams needs a number of words of one or more")
            schema = StructType().add("pos", IntegerType())
            for i in range(1, k.value + 1):
                schema = schema.add(f"w{i}", StringType())
            return AnalyzeResult(schema=schema)

        def eval(self, text: str, k: int):
            words = (text or "").split()
            for i in range(len(words) - k + 1):
                yield (i, *words[i : i + k])

    class Score:
        def eval(self, h2: float, ttr: float, exponent: float, h2_0: float, ttr_0: float, exponent_0: float):
            a, b, c = abs(h2 - h2_0), abs(ttr - ttr_0), abs(exponent - exponent_0)
            yield (3 * a * a + 1.5 * b * b + 2 * c * c) ** 0.5, a <= NEAR[0] and b <= NEAR[1] and c <= NEAR[2]

    spark.udtf.register("generated", udtf(Generated))
    spark.udtf.register("model_grid", udtf(Grid, returnType="params STRING"))
    spark.udtf.register("ngrams", udtf(Grams))
    spark.udtf.register("quick_score", udtf(Score, returnType="distance DOUBLE, near BOOLEAN"))


#: How near entropy, type-token ratio and exponent must be to count as a match.
NEAR = (0.3, 0.1, 0.3)


def profiles(texts: DataFrame) -> DataFrame:
    """(run, h1, h2, h3, exponent, ttr, words) of ``texts`` (run, toks); a written table. Texts are made or read once: words and letters come from one count."""
    tables = Tables(texts.sparkSession)
    after = tables.put(stats.words_after(texts, "run"), "words")
    counts = after.groupBy("run", "tok").agg(F.sum("n").alias("c"))
    h = stats.char_entropies(stats.grams_of(after, "run"), "run").select("run", "h1", "h2", "h3")
    z = stats.zipf(counts, "run").select("run", "exponent", "ttr", F.col("total").alias("words"))
    done, _ = materialize(h.join(z, "run"), "profiles")
    tables.drop()
    return done


def passes(name: str, profile: Row) -> bool:
    """The model's own test of a profile."""
    return bool(MODELS[name](**{}).critical({k: profile[k] or 0.0 for k in ("h1", "h2", "h3", "exponent", "ttr")}))
