"""Text operators. Word lists of other languages come from the stop word lists that ship with Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, StopWordsRemover, Word2Vec
from pyspark.sql import functions as F

from tessera.functions.expressions import strip_accents
from tessera.operators.durable import free_name, numbered
from tessera.operators.registry import IN, OUT, ParameterError, flag, names, need, operator
from tessera.operators.tagging import tag_or_look_up


def _each(inputs, attributes, alias, f):
    found = names(need(attributes, "attributes"))
    new = [x.strip() for x in (alias.split(",") if isinstance(alias, str) else alias or [])] + [None] * len(found)
    return {OUT: inputs[IN].withColumns({b or f"{a}_out": f(F.col(a)) for a, b in zip(found, new, strict=False)})}


@operator("tokenizer", "tokenize")
def tokenizer(inputs, attributes=None, alias=None, type="simple", expression=r"\s+", min_token_length=3, **_):  # noqa: A002
    """Lower-cased parts between matches of the expression, of a least length; in the engine's own functions."""
    cut = r"\s+" if type == "simple" else expression
    return _each(inputs, attributes, alias, lambda c: F.filter(F.split(F.lower(c), cut), lambda x: F.length(x) >= int(min_token_length)))


@operator("remove-stop-words")
def remove_stop_words(inputs, attributes=None, alias=None, language="english", stop_word_list=None, stop_word_attribute=None, sw_case_sensitive=False, **_):
    """Stop words come from a second input if there is one, else the list, else the language. A table of stop words is a
    vocabulary; its distinct words go into one array."""
    if inputs.get("stop words") is not None:
        table = inputs["stop words"]
        listed = [r[0] for r in table.select(stop_word_attribute or table.columns[0]).distinct().collect()]
    elif stop_word_list:
        listed = [w.strip() for w in stop_word_list.split(",")] if isinstance(stop_word_list, str) else stop_word_list
    else:
        listed = StopWordsRemover.loadDefaultStopWords(language)
    if flag(sw_case_sensitive):
        return _each(inputs, attributes, alias, lambda c: F.filter(c, lambda x: ~x.isin(listed)))
    lower = [w.lower() for w in listed]
    return _each(inputs, attributes, alias, lambda c: F.filter(c, lambda x: ~F.lower(x).isin(lower)))


@operator("generate-n-grams", "n-grams")
def n_grams(inputs, attributes=None, alias=None, n=2, **_):
    n = int(n)
    return _each(inputs, attributes, alias, lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>")))


@operator("word-to-vector")
def word_to_vector(inputs, attributes=None, alias=None, type="count", vocab_size=1000, minimum_df=1, minimum_tf=1, minimum_size=3, minimum_count=0, **_):  # noqa: A002
    """count, tf-idf, hashing_tf or word2vec of arrays of words."""
    df, a = inputs[IN], names(need(attributes, "attributes"))[0]
    to = alias or f"{a}_vec"
    vocabulary = None
    if type in ("count", "tf-idf", "tfidf"):
        model = CountVectorizer(inputCol=a, outputCol=to, vocabSize=int(vocab_size), minDF=float(minimum_df), minTF=float(minimum_tf)).fit(df)
        vocabulary, made = model.vocabulary, model.transform(df)
        if type != "count":
            made = made.withColumnRenamed(to, "_tf")
            model = IDF(inputCol="_tf", outputCol=to).fit(made)
            made = model.transform(made).drop("_tf")
    elif type == "hashing_tf":
        model = HashingTF(inputCol=a, outputCol=to, numFeatures=int(vocab_size))
        made = model.transform(df)
    elif type == "word2vec":
        model = Word2Vec(inputCol=a, outputCol=to, vectorSize=int(vocab_size), minCount=int(minimum_count)).fit(df)
        made = model.transform(df)
    else:
        raise ParameterError(f"unknown type: {type}")
    return {OUT: made, "vocabulary": vocabulary, "vector-model": model}


@operator("nlp-word-counting")
def word_counting(inputs, attributes=None, **_):
    a = names(need(attributes, "attributes"))[0]
    return {OUT: inputs[IN].select(F.explode(F.split(F.lower(a), r"\s+")).alias("word")).filter("word <> ''").groupBy("word").count()}


@operator("nlp-lower-case")
def lower_case(inputs, attributes=None, alias=None, **_):
    return _each(inputs, attributes, alias, F.lower)


@operator("normalizer")
def normalizer(inputs, attributes=None, alias=None, **_):
    return _each(inputs, attributes, alias, lambda c: F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"[^\p{L}\p{N}]+", " ")))


# --- stemming: the published rules of the English suffix stripper


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if a == "v" and b == "c")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


# fixed values: suffixes of steps 2, 3 and 4 of the published algorithm
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    """The Porter stem of a lower-case English word."""
    if len(w) <= 2:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@operator("stemming")
def stemming(inputs, attributes=None, alias=None, **_):
    """Stems of arrays of words; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            yield s.map(lambda ws: None if ws is None else [known.setdefault(w, stem(w.lower())) for w in ws])

    return _each(inputs, attributes, alias, stems)


@operator("wordsegmentation")
def word_segmentation(inputs, attributes=None, alias=None, vocabulary=None, **_):
    """Text without blanks to words: the most probable split under given word counts {word: n}, by dynamic programming."""
    counts = dict(need(vocabulary, "vocabulary"))
    total, longest = sum(counts.values()), max(map(len, counts))

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        import math

        cost = {w: -math.log(n / total) for w, n in counts.items()}

        def best(t):
            if t is None:
                return None
            t = t.lower()
            least, back = [0.0] + [math.inf] * len(t), [0] * (len(t) + 1)
            for i in range(1, len(t) + 1):
                for j in range(max(0, i - longest), i):
                    c = least[j] + cost.get(t[j:i], math.log(total) + 10.0 * (i - j))
                    if c < least[i]:
                        least[i], back[i] = c, j
            out, i = [], len(t)
            while i:
                out.append(t[back[i] : i])
                i = back[i]
            return out[::-1]

        return s.map(best)

    return _each(inputs, attributes, alias, cut)


def _dictionary(slug: str):
    def look_up(inputs, attributes=None, alias=None, **_):
        """Words of an array looked up in a table (word, value), the second input; a join, as tables may be large. Values line up with
        words: a word without an entry and a null word have null; of several entries the least counts."""
        df, table = inputs[IN], inputs.get("dictionary")
        if table is None:
            raise ParameterError(f"{slug} needs an input 'dictionary' of words and values")
        a = names(need(attributes, "attributes"))[0]
        row, place, word, value, found = free_name(df, "_id", "_pos", "_word", "_value", "_found")
        rows = numbered(df, row)  # a table of its own: rows keep their numbers
        entries = table.toDF(word, value).filter(F.col(word).isNotNull()).groupBy(word).agg(F.min(value).alias(value))
        pairs = rows.select(row, F.posexplode(a).alias(place, word)).join(entries, word, "left")
        told = pairs.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(found))
        out = rows.join(told, row, "left").withColumn(found, F.when(F.size(a) == 0, F.array().cast(told.schema[found].dataType)).otherwise(F.col(found)))
        return {OUT: out.withColumn(alias or f"{a}_{slug}", F.col(found)).drop(row, found)}

    return look_up


for _slug in ("synonyms", "antonyms", "definer", "lemmatization"):
    operator(_slug)(_dictionary(_slug))
for _slug in ("postagging", "ner"):
    tag_or_look_up(_slug, _dictionary(_slug))
