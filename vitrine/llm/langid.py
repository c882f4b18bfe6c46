"""Language identification by **Bayesian evidence fusion**.

    P(l | document)  ~  P(l | host) * P(declared | l) * P(text | l)

* ``P(text | l)``: trigram model over letters (bytes a-z and non-ASCII, ASCII
  lower-cased, every other run one space), hashed to 65,536 buckets. Trigrams
  overlap, so the log-likelihood counts each letter once (a third of the sum).
  It is fitted on a bounded sample of labelled rows (``per_language``).
* ``P(declared | l)``: how often texts of language l declare each language in
  their markup (or metadata), from a grouped aggregation of the text posteriors.
* ``P(l | host)``: hierarchically smoothed: host counts are smoothed towards the
  domain's, those towards the address suffix's, and those towards the corpus. A
  document's own posterior is taken out of all four counts before.

An extra class ``und`` has the same likelihood for every trigram; a text that it
explains better than any language, or with no letters and no other evidence
strong enough, is undetermined. The text is read once; everything after works
on one small row per document, written to the checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import SALTS, broadcast_if_small, freeze, ship_texts

BUCKETS = 1 << 16
#: Prior of the class that stands for no known language.
UND_PRIOR = 1e-3
#: Pseudo-counts that a level of the address hierarchy takes from the level above.
SMOOTHING = 5.0
#: Added to each cell of the table of declared languages.
DECLARED_SMOOTHING = 1.0
#: Second-level labels under which names are registered in two-letter suffixes, as in co.uk.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ne", "net", "or", "org")
#: More distinct hosts than this are joined by salted shuffle instead of broadcast.
BROADCAST_HOSTS = 20_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
DECLARED = r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null where there is none."""
    h = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(h != "", h)


def declared_in_markup(html: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of ``<html>``, null where there is none."""
    d = F.lower(F.regexp_extract(html, DECLARED, 1))
    return F.when(d != "", d)


def trigrams(text: bytes):
    """Bucket of every letter trigram of a UTF-8 text."""
    import numpy as np

    b = _letters()[np.frombuffer(text, np.uint8)]
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]  # runs of blanks become one
    if len(b) < 3:
        return np.empty(0, np.uint32)
    h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(16)


def _letters():
    import numpy as np

    t = np.full(256, 32, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    for c in range(26):
        t[97 + c] = t[65 + c] = 97 + c
    return t


def fit_text_model(docs: DataFrame, label: Column, languages: tuple[str, ...], per_language: int = 500,
                   id_col: str = "doc_id", text_col: str = "text"):
    """Log-probabilities ``(languages found, array[len, BUCKETS])`` from at most
    ``per_language`` labelled rows of each language (those with the smallest hash
    of their id). Languages without a labelled text are left out."""
    import numpy as np

    ship_texts(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), label.alias("label"))
    picks = [rows.where(F.col("label") == lang).orderBy(F.xxhash64("id"), "id").limit(per_language)
             for lang in languages]
    sample = reduce(DataFrame.unionAll, picks).where("id IS NOT NULL").distinct()
    texts = (docs.select(F.col(id_col).alias("id"), label.alias("label"), F.col(text_col).cast("string").alias("text"))
             .where("text IS NOT NULL").join(F.broadcast(sample), ["id", "label"], "left_semi")  # at most the bound
             .select("label", "text").repartition(8))
    names = list(languages)

    def count(batches):
        import pyarrow as pa

        sums = {}
        for b in batches:
            for lab, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                t = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
                sums[lab] = sums.get(lab, 0) + t
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                              pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
                                             names=["label", "counts"])

    total = {}
    for r in texts.mapInArrow(count, "label string, counts binary").collect():  # 8 tasks x languages x 512 KB at most
        total[r.label] = total.get(r.label, 0) + np.frombuffer(r.counts, "<i8")
    found = [lang for lang in names if lang in total and total[lang].sum()]
    model = np.zeros((len(found), BUCKETS))
    for k, lang in enumerate(found):
        model[k] = np.log((total[lang] + 0.1) / (total[lang].sum() + 0.1 * BUCKETS))
    return found, model


def text_evidence(docs: DataFrame, model, columns: dict[str, Column], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(id, *columns, letters, ll array<double>)``: log-likelihood per language and,
    last, of ``und``, each less the largest; ``letters`` trigrams were read."""
    import numpy as np

    ship_texts(docs.sparkSession)
    found, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([logp, np.full(BUCKETS, -np.log(BUCKETS))])
                                                      .astype(np.float32))
    names = list(columns)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            n, ll = [], []
            for text in b.column(b.num_columns - 1).cast(pa.binary()):
                t = trigrams(text.as_py() or b"")
                total = np.zeros(len(m))
                for k in range(0, len(t), 1 << 16):  # bounded memory for very long texts
                    total += m[:, t[k:k + (1 << 16)]].sum(1, dtype=np.float64)
                n.append(len(t))
                ll.append(((total - total.max()) / 3).tolist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))],
                names=["id", *names, "letters", "ll"])

    cols = [columns[c].cast("string").alias(c) for c in names]
    schema = "id long, " + "".join(f"{c} string, " for c in names) + "letters long, ll array<double>"
    return docs.select(F.col(id_col).cast("long").alias("id"), *cols, F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema)


def _normal(weights: list[Column]) -> list[Column]:
    total = reduce(Column.__add__, weights)
    return [w / total for w in weights]


def _suffix(host: Column) -> Column:
    """The part of a host that names are registered under: its last label, or its last
    two where a registry's label stands before a two-letter one."""
    pattern = rf"(?:^|\.)((?:(?:{'|'.join(REGISTRIES)})\.)?[a-z]{{2}}|[^.]*)$"
    return F.regexp_extract(F.lower(host), pattern, 1)


def _domain(host: Column) -> Column:
    """The suffix and the label before it; the host itself where there is none."""
    labels = F.size(F.split(_suffix(host), r"\.")) + 1
    parts = F.split(F.lower(host), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), labels), ".")


def _host_counts(rows: DataFrame, n: int) -> DataFrame:
    """``(host, nh, nd, ns)``: the counts of the ``n`` classes of every host, of its
    domain and of its suffix. A parent's row is handed out once for every salt that its
    children use, so the hosts of one suffix are spread over tasks."""
    def salt(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")

    def total(k: int, of: str) -> Column:
        return F.sum(F.col(of)[k]) if of != "p" else F.sum(f"p{k}")

    def up(child: DataFrame, counts: str, key: str, name: str, keep: list[str]) -> DataFrame:
        used = F.bit_or(F.call_function("shiftleft", F.lit(1), salt(child.columns[0]))).alias("used")
        per = child.groupBy(key, *keep).agg(F.array(*[total(k, counts) for k in range(n)]).alias(name), used)
        return per.select(key, *keep, name, F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("used", k) == 1).alias("salts"))

    def down(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        handed = parent.select(key, *[c for c in parent.columns if c not in (key, "salts", "suffix")], F.explode("salts").alias("salt"))
        return child.withColumn("salt", salt(child.columns[0])).join(handed, [key, "salt"]).drop("salt")

    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.array(*[total(k, "p") for k in range(n)]).alias("nh"))
    hosts = freeze(hosts.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host"))))
    domains = freeze(up(hosts, "nh", "domain", "nd", ["suffix"]))
    suffixes = up(domains.select("domain", "suffix", "nd"), "nd", "suffix", "ns", [])
    known = down(domains.select("domain", "suffix", "nd", "salts"), suffixes, "suffix")
    return down(hosts.drop("suffix"), known.select("domain", "nd", "ns", "salts"), "domain").select("host", "nh", "nd", "ns")


def _normal_array(weights: Column) -> Column:
    """``weights`` over their sum; the array is bound, so that it is computed once."""
    def shares(w: Column) -> Column:
        return F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b))
    return F.transform(F.array(weights), shares)[0]


def _prior(n: int, root: list[float]) -> Column:
    """The classes' prior of a row from its host's counts without its own posterior
    ``own``, null where there is no host. Each level takes ``SMOOTHING`` pseudo-counts
    from the one above."""
    base = F.array(*[F.lit(UND_PRIOR if k == n - 1 else (1 - UND_PRIOR) / max(1, n - 1)) for k in range(n)])
    prior = base
    for counts in (F.array(*[F.lit(x) for x in root]), F.col("ns"), F.col("nd"), F.col("nh")):
        others = F.zip_with(counts, F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
        prior = _normal_array(F.zip_with(others, prior, lambda c, q: c + F.lit(SMOOTHING) * q))
    return F.when(F.col("nh").isNotNull(), prior)


def identify(docs: DataFrame, languages: tuple[str, ...], declared: Column, host: Column, model=None,
             per_language: int = 500, id_col: str = "doc_id", text_col: str = "text",
             min_confidence: float = 0.5) -> DataFrame:
    """``(id, language, confidence, text_language, declared, host, letters, kept)``,
    one row per row of ``docs``.

    ``kept`` is false where the language is undetermined or its posterior is
    under ``min_confidence``. A null or empty text has no evidence of its own and
    is undetermined, whatever its host and declaration say. Missing hosts take the
    corpus prior, missing declarations count as a value of their own. Repeated rows are
    judged alike; ties go to the language listed first; an empty table gives an
    empty result; columns other than the named ones are not read.
    """
    if model is None:
        model = fit_text_model(docs, declared, languages, per_language, id_col, text_col)
    found = model[0]
    names, n = [*found, "und"], len(found) + 1
    said = F.lower(F.regexp_extract(declared, "^([A-Za-z]+)", 1))
    rows = text_evidence(docs, model, {
        "declared": F.when(declared.isNull() | (said == ""), "(none)").when(said.isin(*found), said).otherwise("(other)"),
        "host": host}, id_col, text_col)
    e = [F.exp(F.col("ll")[k]) * ((1.0 - UND_PRIOR) / max(1, n - 1) if k < n - 1 else UND_PRIOR) for k in range(n)]
    rows = rows.select("*", *[p.alias(f"p{k}") for k, p in enumerate(_normal(e))])
    rows = freeze(rows)

    # how texts of each language declare themselves: at most languages + 2 rows, bounded by the argument
    seen = rows.where("letters > 0").groupBy("declared").agg(*[F.sum(f"p{k}").alias(f"n{k}") for k in range(n)]).collect()
    values = [*found, "(other)", "(none)"]
    table = {r["declared"]: [float(r[f"n{k}"]) for k in range(n)] for r in seen}
    cells = {v: [x + DECLARED_SMOOTHING for x in table.get(v, [0.0] * n)] for v in values}
    column = [sum(cells[v][k] for v in values) for k in range(n)]
    lik = F.create_map(*[x for v in values for x in (
        F.lit(v), F.array(*[F.lit(cells[v][k] / column[k]) for k in range(n)]))])

    counted = (F.col("letters") > 0) & F.col("host").isNotNull()
    sums = rows.where(counted).agg(*[F.sum(f"p{k}").alias(f"r{k}") for k in range(n)]).first()
    root = [float(sums[f"r{k}"] or 0.0) for k in range(n)]
    counts = freeze(_host_counts(rows.where(counted), n))
    total = [sum(cells[v][k] for v in values) for k in range(n)]
    corpus = F.array(*[F.lit(x / sum(total)) for x in total])
    small = broadcast_if_small(counts, BROADCAST_HOSTS)
    if small is not counts:
        joined = rows.join(small, "host", "left")
    else:
        salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")) \
            .join(salted, ["host", "_salt"], "left")
    own = F.array(*[F.when(counted, F.col(f"p{k}")).otherwise(0.0) for k in range(n)])
    joined = joined.withColumn("own", own)
    prior, d = F.coalesce(_prior(n, root), corpus), F.element_at(lik, F.col("declared"))
    post = joined.select("id", "declared", "host", "letters", "ll", prior.alias("prior"), d.alias("d"),
                         F.array(*[f"p{k}" for k in range(n)]).alias("p"))
    w = _normal([F.exp(F.col("ll")[k]) * F.col("prior")[k] * F.col("d")[k] for k in range(n)])
    post = post.select("id", "declared", "host", "letters", "p", F.array(*w).alias("w"))
    lookup = F.array(*[F.lit(x) for x in names])

    def best(c: str) -> Column:
        return F.element_at(lookup, F.array_position(F.col(c), F.array_max(c)).cast("int"))

    text = F.col("letters") > 0
    language = F.when(text, best("w")).otherwise("und")
    confidence = F.when(text, F.array_max("w")).otherwise(F.lit(0.0))
    return post.select("id", language.alias("language"), confidence.alias("confidence"),
                       F.when(text, best("p")).otherwise("und").alias("text_language"), "declared", "host", "letters",
                       ((language != "und") & (confidence >= min_confidence)).alias("kept"))
