"""Finding house clauses for a target's clauses: staged filters, affinity, freshness, ranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import editing, fixed
from docmill.functions.text import word_set
from docmill.operators.joins import as_of
from docmill.operators.tasks import arrow_schema, ddl, saved

#: Rows of a family's targets, and of its library, that are joined as one block.
BLOCK = 8192
#: Sets of words that are compared in one row, a target's block and a library's, and about the most words of a block.
ASKED_BLOCK, HELD_BLOCK, WORDS_BLOCK = 4096, 4096, 1 << 20
#: Rows that may be sent to every task: classes of a library, a few a family, and hashes of ids, 8 bytes each.
CLASSES_SENT, KEYS_SENT = 1 << 14, 1 << 20


def exact_or_null(library: Column, target: Column) -> Column:
    """A library value of null matches anything; so does a target without a value (our rule)."""
    return library.isNull() | target.isNull() | (library == target)


def _fitting(targets: DataFrame, library: DataFrame, family: str, optional: tuple[str, ...], required: dict[str, str] | None) -> tuple[DataFrame, Column]:
    """The library's rows that may be candidates, as ``lib_...``, and the condition under which one is a target's."""
    lib = library
    for c, v in ({"approval_state": "approved", "status": "active"} if required is None else required).items():
        lib = lib.where(F.col(c) == v)
    lib = lib.select(*(F.col(c).alias(f"lib_{c}") for c in lib.columns))
    on = F.col(family) == F.col(f"lib_{family}")
    for c in optional:
        on = on & exact_or_null(F.col(f"lib_{c}"), F.col(c))
    return lib, on


def stage_one(targets: DataFrame, library: DataFrame, family: str = "contract_family", optional: tuple[str, ...] = ("jurisdiction", "governing_law"), required: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Candidates of each target: one family, null-tolerant residuals, approved and active.

    The family is an equi-join key, so the join is hashed; required values filter the library's scan first.  Both sides of a
    family are dealt into blocks of about ``block`` rows, whose numbers are keys, too: a large family is many small joins of
    a block with a block, and no task has all of its pairs.
    """
    lib, on = _fitting(targets, library, family, optional, required)
    sized = lambda rows, key, name: rows.groupBy(F.col(key).alias("_family")).agg(F.ceil(F.count("*") / block).alias(name))
    grid = sized(targets, family, "_rows").join(sized(lib, f"lib_{family}", "_columns"), "_family")
    deal = lambda rows, of: F.pmod(F.xxhash64(*(F.col(c) for c, t in rows.dtypes if "map<" not in t)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    a = targets.join(grid, F.col(family) == F.col("_family")).withColumn("_row", deal(targets, "_rows")).withColumn("_column", every("_columns"))
    b = lib.join(grid, F.col(f"lib_{family}") == F.col("_family")).withColumn("_lib_column", deal(lib, "_columns")).withColumn("_lib_row", every("_rows"))
    # a number that is given keeps the blocks of one family apart, small as they are
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = a.drop("_family", "_rows", "_columns").repartition(parts, family, "_row", "_column")
    b = b.drop("_family", "_rows", "_columns").repartition(parts, f"lib_{family}", "_lib_row", "_lib_column")
    blocks = (F.col("_row") == F.col("_lib_row")) & (F.col("_column") == F.col("_lib_column"))
    return a.join(b.hint("shuffle_hash"), on & blocks).drop("_row", "_column", "_lib_row", "_lib_column")


def nearest(targets: DataFrame, library: DataFrame, key: str, near: str, narrow_by: str = "clause_type", family: str = "contract_family", optional: tuple[str, ...] = ("jurisdiction", "governing_law"), required: dict[str, str] | None = None, id: str = "doc_id") -> DataFrame:
    """Of the candidates of each target some that have the first by an equal ``narrow_by``, the least difference in ``near``
    and the least ``id`` among them: all that ``best`` needs in this order, without the pairs.

    Of the library's rows with one family, optional values, ``narrow_by`` and ``near`` the least ``id`` stays.  Each target
    meets the groups of its family, a few, and in each the nearest values below and above, by windows in their order.  A
    group's least ``id``, and that without a value, come along for targets and rows that have none.  Columns: those of the
    targets, and of the library those named here.
    """
    lib, on = _fitting(targets, library, family, optional, required)
    parts = [f"lib_{c}" for c in (family, *optional, narrow_by)]
    held = lib.groupBy(*parts, f"lib_{near}").agg(F.min(f"lib_{id}").alias(f"lib_{id}"))
    value = F.struct(F.col(f"lib_{near}").alias("near"), F.col(f"lib_{id}").alias("id"))
    ids = F.struct(F.col(f"lib_{id}").alias("id"), F.col(f"lib_{near}").alias("near"))
    groups = held.groupBy(*parts).agg(F.min(ids).alias("_least"), F.min(F.when(F.col(f"lib_{near}").isNull(), ids)).alias("_none"))
    asked = targets.join(groups, on)
    found = asked.select(*asked.columns[: len(targets.columns)], *parts, F.explode(F.array("_least", "_none")).alias("_v")).where("_v is not null")
    found = found.select(*targets.columns, *parts, F.col("_v.near").alias(f"lib_{near}"), F.col("_v.id").alias(f"lib_{id}"))
    rows = asked.where(F.col(near).isNotNull()).select(*targets.columns, *parts)
    named = F.struct(*(F.col(c).alias(f"t_{c}") for c in targets.columns))
    rows = rows.select(*parts, F.col(near).alias("_at"), named.alias("_own"))
    some = held.where(F.col(f"lib_{near}").isNotNull()).select(*parts, F.col(f"lib_{near}").alias("_at"), value.alias("_found"))
    for sign in (1, -1):
        a, b = (x.withColumn("_at", F.col("_at") * sign) for x in (rows, some))
        side = as_of(a, b, parts, "_at", ["_found"]).where("_found is not null")
        side = side.select(*(F.col(f"_own.t_{c}").alias(c) for c in targets.columns), *parts, F.col("_found.near").alias(f"lib_{near}"), F.col("_found.id").alias(f"lib_{id}"))
        found = found.union(side)
    return found


def candidates(targets: DataFrame, library: DataFrame, key: str, narrow_by: str = "clause_type", above: int = fixed.NARROW_ABOVE, family: str = "contract_family", optional: tuple[str, ...] = ("jurisdiction", "governing_law"), required: dict[str, str] | None = None) -> DataFrame:
    """``stage_one`` and then ``narrow`` by an equal ``narrow_by``, without making the pairs that are narrowed away.

    The library's rows are counted by family and optional values, a few rows a family; from these each target's number of
    candidates follows.  Targets with more than ``above`` get ``narrow_by`` as a second key of their join.
    """
    lib = library
    for c, v in ({"approval_state": "approved", "status": "active"} if required is None else required).items():
        lib = lib.where(F.col(c) == v)
    held = lib.groupBy(family, *optional).agg(F.count("*").alias("_n")).select("_n", *(F.col(c).alias(f"lib_{c}") for c in (family, *optional)))
    fits = F.col(family) == F.col(f"lib_{family}")
    for c in optional:
        fits = fits & exact_or_null(F.col(f"lib_{c}"), F.col(c))
    many = targets.select(key, family, *optional).distinct().join(held, fits).groupBy(key).agg(F.sum("_n").alias("_n")).where(F.col("_n") > above).select(F.col(key).alias("_many"))
    how = {"family": family, "optional": optional, "required": {}}
    few = targets.join(many, targets[key].eqNullSafe(many["_many"]), "left_anti")
    rest = targets.join(many, targets[key].eqNullSafe(many["_many"]), "left_semi")
    same = F.col(narrow_by) == F.col(f"lib_{narrow_by}")
    return stage_one(few, lib, **how).unionByName(stage_one(rest, lib, **how).where(same))


def narrow(candidates: DataFrame, target: str | list[str], same: Column, above: int = fixed.NARROW_ABOVE) -> DataFrame:
    """Targets with more than ``above`` candidates keep those for which ``same`` holds.

    Candidates are counted on the map side and the counts joined, so that no window gathers a target's candidates.
    """
    keys = [target] if isinstance(target, str) else target
    many = candidates.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > above).select("_n", *(F.col(k).alias(f"_{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return candidates.join(many, on, "left").where(F.col("_n").isNull() | same).drop("_n", *(f"_{k}" for k in keys))


def exclude(candidates: DataFrame, library: DataFrame, key: str = "doc_id", prefix: str = "lib_", values: dict[str, list[str]] | None = None, superseded: bool = True) -> DataFrame:
    """Without candidates of excluded values (archived, quarantined), and without superseded ones that have an active
    successor.  ``prefix`` is that of the candidates' columns: empty for rows of a library itself."""
    ok = candidates
    for column, out in ({"status": ["archived"], "approval_state": ["quarantined"]} if values is None else values).items():
        ok = ok.where(~F.coalesce(F.col(f"{prefix}{column}").isin(out), F.lit(False)))
    if not superseded:
        return ok
    alive = library.where((F.col("status") == "active") & F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("_old")).distinct()
    gone = (F.col(f"{prefix}{key}") == F.col("_old")) & (F.col(f"{prefix}status") == "superseded")
    return ok.join(alive, gone, "left_anti")


def external_only(rows: DataFrame, external: bool, safe: str = "lib_external_safe") -> DataFrame:
    """In an external context only what may be shown outside; a null is not safe."""
    return rows.where(F.coalesce(safe, F.lit(False))) if external else rows


def affinity_pairs(spark, groups: list[list[str]] | None = None) -> DataFrame:
    """``family, related``: every two families of one group, once."""
    pairs = sorted({p for g in (fixed.AFFINITY if groups is None else groups) for p in permutations(g, 2)})
    return spark.createDataFrame(pairs, "family string, related string")


def widen(candidates: DataFrame, targets: DataFrame, library: DataFrame, pairs: DataFrame, target: str, family: str = "contract_family", below: int = fixed.WIDEN_BELOW, penalty: int = fixed.PENALTY, **how) -> DataFrame:
    """``candidates`` and, for targets with fewer than ``below``, those of related families with a rank ``penalty``."""
    few = targets.join(candidates.groupBy(target).agg(F.count("*").alias("_n")), target, "left").where(F.coalesce("_n", F.lit(0)) < below).drop("_n")
    other = few.join(F.broadcast(pairs), F.col(family) == F.col("family")).drop("family").withColumn("_own", F.col(family)).withColumn(family, F.col("related")).drop("related")
    more = stage_one(other, library, family, **how).withColumn(family, F.col("_own")).drop("_own").withColumn("penalty", F.lit(penalty))
    return candidates.withColumn("penalty", F.lit(0)).unionByName(more)


def likeliest(targets: DataFrame, library: DataFrame, pairs: DataFrame, key: str, rank: Column, text: str = "text", narrow_by: str = "clause_type", above: int = fixed.NARROW_ABOVE, family: str = "contract_family", optional: tuple[str, ...] = ("jurisdiction", "governing_law"), required: dict[str, str] | None = None, below: int = fixed.WIDEN_BELOW, penalty: int = fixed.PENALTY) -> DataFrame:
    """Of the ``candidates`` of each target, widened (see ``widen``), some that have the first by ``rank`` and ``penalty``,
    an equal ``narrow_by``, the share of common words, and the library's ids among them; with ``penalty``.

    The library's rows fall into classes by family, optional values, ``narrow_by`` and rank, a few a family.  From their
    counts follow what is narrowed, what is widened, and the classes in which a target's first candidate is.  Only in these
    words are compared: equal sets of words are one, and blocks of sets meet in a row (``editing.most_alike``).  The pairs of
    sets grow with both sides, but no row is made of them.  ``rank``: over the library's columns as ``lib_...``.  The classes
    reached, both sides' sets and what was found are written once, for each is read several times.
    """
    lib = library
    for c, v in ({"approval_state": "approved", "status": "active"} if required is None else required).items():
        lib = lib.where(F.col(c) == v)
    lib = lib.select(*(F.col(c).alias(f"lib_{c}") for c in lib.columns))
    lib = lib.withColumn("_class", F.struct(*(f"lib_{c}" for c in (family, *optional, narrow_by)), rank.alias("_rank")))
    classes = lib.groupBy("_class").agg(F.count("*").alias("_n")).select("_class", "_n", "_class.*")
    fits = lambda own: F.col(own) == F.col(f"lib_{family}")
    same = F.col(narrow_by) == F.col(f"lib_{narrow_by}")

    def meeting(rows: DataFrame, own: str) -> DataFrame:
        on = fits(own)
        for c in optional:
            on = on & exact_or_null(F.col(f"lib_{c}"), F.col(c))
        return rows.join(classes, on).withColumn("_same", same)

    asked = targets.select(key, family, *optional, narrow_by).distinct()
    held = meeting(asked, family)
    total = held.groupBy(key).agg(F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_same"), F.col("_n"))), F.lit(0)).alias("_alike"))
    own = held.join(total, key).where((F.col("_all") <= above) | F.col("_same"))
    left = F.when(F.col("_all") > above, F.col("_alike")).otherwise(F.col("_all"))
    few = asked.join(total, key, "left").where(F.coalesce(left, F.lit(0)) < below).select(*asked.columns)
    near = pairs.select(F.col("family").alias("_own"), F.col("related").alias("_related"))
    more = meeting(few.join(F.broadcast(near), F.col(family) == F.col("_own")), "_related")
    place = lambda more: F.struct((F.col("_rank") + more).alias("r"), F.when(F.col("_same"), 0).when(F.col("_same").isNull(), 2).otherwise(1).alias("s"))
    reach = own.select(key, "_class", F.lit(0).alias("penalty"), place(0).alias("_place")).union(more.select(key, "_class", F.lit(penalty).alias("penalty"), place(penalty).alias("_place")))
    first = reach.groupBy(key).agg(F.min("_place").alias("_first"))
    reach = saved(reach.join(first, key).where(F.col("_place") == F.col("_first")).select(key, "_class", "penalty").distinct(), "reach")

    # a set is a text: sorted words, which have no blanks
    said = lambda c: F.array_sort(F.coalesce(word_set(F.col(c)), F.array().cast("array<string>")))
    named = lambda rows: rows.withColumns({"_set": F.sha2(F.array_join("_words", " "), 256), "_n": F.size("_words"), "_words": F.array_join("_words", " ")})
    wanted = saved(named(targets.select(key, said(text).alias("_words"))).join(reach, key), "wanted")
    reached = saved(reach.select("_class").distinct(), "classes")
    few_classes = reached.count() <= CLASSES_SENT
    sent = lambda classes: F.broadcast(classes) if few_classes else classes
    there = lib.join(sent(reached), "_class", "left_semi")
    there = named(there.select("_class", "lib_doc_id", "lib_clause_id", said(f"lib_{text}").alias("_words")))
    sets = saved(there.groupBy("_class", "_set").agg(F.min(F.struct("lib_doc_id", "lib_clause_id")).alias("_id"), F.first("_words").alias("_words"), F.first("_n").alias("_n")), "sets")

    def blocks(rows: DataFrame, most: int, name: str, *fields: str) -> DataFrame:
        count = rows.groupBy("_class").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("_n") / WORDS_BLOCK)).alias("_of"))
        dealt = rows.join(sent(count), "_class").withColumn("_block", F.pmod(F.xxhash64("_set"), "_of"))
        return dealt.groupBy("_class", F.col("_block").alias(f"{name}_block")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    a = blocks(wanted.select("_class", "_set", "_words", "_n").dropDuplicates(["_class", "_set"]), ASKED_BLOCK, "_asked", "_set", "_words")
    b = blocks(sets, HELD_BLOCK, "_held", "_id", "_words")
    # a number that is given keeps the cells of one class apart, small as they are
    cells = a.join(b, "_class").repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_class", "_asked_block", "_held_block")

    made = ddl([("_class", dict(sets.dtypes)["_class"]), ("_set", "string"), ("_less", "double"), ("_id", dict(sets.dtypes)["_id"])])
    out = arrow_schema(made)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, asked = batch["_asked"][i].values.flatten()
                ids, held = batch["_held"][i].values.flatten()
                at, share = editing.most_alike(asked, held)
                columns = batch["_class"].take(pa.array([i] * len(own))), own, pa.array(-share), ids.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    alike = cells.select("_class", "_asked", "_held").mapInArrow(work, made)
    alike = alike.groupBy("_class", "_set").agg(F.min(F.struct("_less", "_id")).alias("_best"))
    won = wanted.select(key, "_class", "penalty", "_set").join(alike, ["_class", "_set"]).select(F.col(key).alias("_key"), F.col("_class").alias("_won"), "penalty", "_best._id.*")
    won = saved(won.withColumnsRenamed({"lib_doc_id": "_doc", "lib_clause_id": "_clause"}), "won")
    # the library's texts are many times those that are wanted: most stay where they are
    ids = won.select(F.xxhash64("_doc").alias("_k")).distinct()
    if ids.count() <= KEYS_SENT:
        lib = lib.withColumn("_k", F.xxhash64("lib_doc_id")).join(F.broadcast(ids), "_k", "left_semi").drop("_k")
    rows = lib.join(won, (F.col("_class") == F.col("_won")) & F.col("lib_doc_id").eqNullSafe(F.col("_doc")) & F.col("lib_clause_id").eqNullSafe(F.col("_clause")))
    rows = rows.drop("_class", "_won", "_doc", "_clause")
    return targets.join(rows, targets[key] == F.col("_key")).drop("_key")


def stale(refreshed: Column, as_of: Column, days: int = fixed.STALE_DAYS) -> Column:
    """Whether the last refresh is more than ``days`` ago; an asset that was never refreshed is not judged."""
    return F.coalesce(F.datediff(as_of, refreshed) > days, F.lit(False))


def freshness(rows: DataFrame, refreshed: str, as_of: Column, handling: str = "downrank", days: int = fixed.STALE_DAYS, penalty: int = fixed.PENALTY) -> DataFrame:
    """``downrank`` adds a penalty, ``exclude`` drops, ``warn_only`` flags stale rows."""
    out = rows.withColumn("stale", stale(F.col(refreshed), as_of, days))
    if handling == "exclude":
        return out.where(~F.col("stale"))
    own = F.col("penalty") if "penalty" in rows.columns else F.lit(0)
    return out.withColumn("penalty", own + F.when(F.col("stale"), penalty).otherwise(0)) if handling == "downrank" else out


def priority(doc_class: Column, authority: Column, approval: Column) -> Column:
    """The name of a candidate's priority level."""
    return (
        F.when(authority == "reference_only", "reference_only")
        .when((doc_class == "precedent") & (approval == "approved"), "approved_precedent")
        .when(doc_class == "template", F.concat(F.coalesce(authority, F.lit("preferred")), F.lit("_template")))
    )


def ranks(spark) -> DataFrame:
    return spark.createDataFrame(fixed.PRIORITY, "priority string, rank int")


def rank_of(name: Column, order: list[tuple[str, int]] | None = None) -> Column:
    """The rank of a priority level; after all others if it is none."""
    order = fixed.PRIORITY if order is None else order
    table = F.create_map(*(F.lit(x) for pair in order for x in pair))
    return F.coalesce(F.try_element_at(table, name), F.lit(max((r for _, r in order), default=0) + 1))


def best(candidates: DataFrame, target: str | list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The ``k`` first candidates of each target; ``order`` must be total.  The limit is taken before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*([target] if isinstance(target, str) else target)).orderBy(*order))
    return candidates.withColumn("place", n).where(F.col("place") <= k)


def match_rate(targets: DataFrame, matched: DataFrame, target: str, goal: float = fixed.MATCH_TARGET) -> DataFrame:
    """``n, matched, rate, reached`` over all targets; an empty library gives a rate of 0 and ``library_empty``."""
    hit = matched.select(target).distinct().withColumn("_hit", F.lit(1))
    out = targets.select(target).distinct().join(hit, target, "left").agg(F.count("*").alias("n"), F.count("_hit").alias("matched"))
    rate = F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0)
    return out.withColumns({"rate": rate, "reached": rate >= goal, "library_empty": F.col("matched") == 0})


def template_for(requests: DataFrame, documents: DataFrame, by: tuple[str, ...] = ("contract_family",), prefer: str = "subtype") -> DataFrame:
    """``requests`` (with ``request_id``) and the best approved template of their family: same subtype, then rank.

    The best template of each family, and of each family and subtype, is found first, on the map side; requests are joined
    with these alone, so nothing has a row for each request and template.
    """
    found = documents.where("doc_class = 'template' and approval_state = 'approved' and status = 'active'")
    rank = rank_of(priority(F.col("doc_class"), F.col("authority_level"), F.col("approval_state")))
    found = found.select(*(F.col(c).alias(f"lib_{c}") for c in (*by, prefer)), F.struct(rank.alias("rank"), F.col("doc_id").alias("id")).alias("_t"))

    def with_best(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
        top = found.groupBy(*(f"lib_{c}" for c in keys)).agg(F.min("_t").alias(name))
        on = F.lit(True)
        for c in keys:
            on = on & (F.col(c) == F.col(f"lib_{c}"))
        return rows.join(top, on, "left").drop(*(f"lib_{c}" for c in keys))

    both = with_best(with_best(requests, (*by, prefer), "_same"), by, "_any")
    # of several rows of one request the first template of all stays
    t = F.coalesce("_same", "_any")
    first = both.where(t.isNotNull()).groupBy("request_id").agg(F.min(F.struct(F.col("_same").isNull().alias("other"), t.alias("t"))).alias("_b"))
    return requests.join(first.select("request_id", F.col("_b.t.id").alias("template_id")), "request_id", "left")
