"""Inserts, upserts, updates and deletes as copy-on-write over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.operators.recursion import shared
from millrace.sources.catalog import Catalog, Table


def coerced(t: Table, df: DataFrame) -> DataFrame:
    """``df`` with declared types; ENUM and SET values in canonical form, bad ones raise 1265."""
    for c in t.stored:
        if c.name not in df.columns:
            continue
        value = F.col(f"`{c.name}`").cast(c.spark_type)
        if c.members:
            members = F.array(*map(F.lit, c.members))
            bad = F.raise_error(F.lit(f"1265:Data truncated for column '{c.name}'"))
            if c.is_set:
                given = F.filter(F.split(F.lower(value), r"\s*,\s*"), lambda x: x != "")
                known = F.filter(members, lambda m: F.array_contains(given, F.lower(m)))
                value = F.when(value.isNull(), None).when(F.size(F.array_except(given, F.transform(members, F.lower))) > 0, bad).otherwise(F.array_join(known, ","))
            else:
                place = F.array_position(F.transform(members, F.lower), F.lower(value))
                value = F.when(value.isNull(), None).when(place == 0, bad).otherwise(F.element_at(members, F.greatest(place, F.lit(1)).cast("int")))
        df = df.withColumn(c.name, value)
    return df


class Writer:
    """Writes to one table with all its checks."""

    def __init__(self, catalog: Catalog, db: str, t: Table):
        self.catalog, self.db, self.t, self.spark = catalog, db, t, catalog.spark
        self.first_id: int | None = None
        #: (op, before, after) DataFrames of the last write, for the change log and triggers.
        self.changes: list[tuple[str, DataFrame | None, DataFrame | None]] = []

    # ---- checks ----

    def check_rows(self, df: DataFrame) -> None:
        """NOT NULL (1048), CHECK (3819) and foreign keys (1452) of new rows, in one pass and one join for each key."""
        t = self.t
        tests = [(1048, f"Column '{c.name}' cannot be null", F.col(f"`{c.name}`").isNull()) for c in t.stored if not c.nullable]
        full = df
        for c in t.columns:
            if c.generated is not None:
                full = full.withColumn(c.name, F.expr(c.generated).cast(c.spark_type))
        tests += [(3819, f"Check constraint '{name}' is violated.", ~F.coalesce(F.expr(sql).cast("boolean"), F.lit(True))) for name, sql in t.checks]
        if tests:
            row = full.agg(*[F.max(test.cast("int")).alias(f"t{i}") for i, (_, _, test) in enumerate(tests)]).first()
            for i, (code, message, _) in enumerate(tests):
                if row[f"t{i}"]:
                    raise EngineError(code, message)
        for fk in t.foreign_keys:
            parent = self.catalog.read(self.catalog.table(self.db, fk.parent)).select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent_columns)])
            child = df.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(fk.columns)]).dropna()
            if child.join(parent, [F.col(f"__c{i}") == F.col(f"__p{i}") for i in range(len(fk.columns))], "left_anti").take(1):
                raise EngineError(1452, f"Cannot add or update a child row: a foreign key constraint fails ({fk.name})")

    def check_unique(self, df: DataFrame) -> None:
        """Error 1062 where two rows of the whole table share a key."""
        for name, columns in self.t.unique_keys():
            keys = [self.key(c).alias(f"k{i}") for i, c in enumerate(columns)]
            if df.select(*keys).dropna().groupBy(*[f"k{i}" for i in range(len(keys))]).count().filter("count > 1").take(1):
                raise EngineError(1062, f"Duplicate entry for key '{self.t.name}.{name}'")

    def key(self, name: str, prefix: str = "") -> Column:
        """The column as unique keys compare it: texts without case and accents."""
        return self.t.column(name).key(F.col(f"`{prefix}{name}`"))

    def check_children(self, gone: DataFrame) -> None:
        """Error 1451 where a row of another table still refers to one of ``gone``."""
        for other in self.catalog.databases[self.db].values():
            for fk in other.foreign_keys:
                if fk.parent.lower() == self.t.name.lower():
                    keys = gone.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent_columns)])
                    if self.catalog.read(other).join(keys, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk.columns)], "left_semi").take(1):
                        raise EngineError(1451, f"Cannot delete or update a parent row: a foreign key constraint fails ({fk.name})")

    # ---- writes ----

    def completed(self, df: DataFrame, given: list[str]) -> DataFrame:
        """All stored columns from the ``given`` ones: defaults, and AUTO_INCREMENT in row order (column __i)."""
        t = self.t
        for c in t.columns:
            if c.generated is not None and c.name in given:
                raise EngineError(3105, f"The value specified for generated column '{c.name}' in table '{t.name}' is not allowed.")
        for c in t.stored:
            if c.name not in given:
                df = df.withColumn(c.name, F.expr(c.default) if c.default is not None else F.lit(None))
                if c.default is None and not c.nullable and not c.auto_increment:
                    raise EngineError(1364, f"Field '{c.name}' doesn't have a default value")
        df = coerced(t, df)
        for c in t.stored:
            if c.auto_increment:
                df = self._numbered(df, c.name, c.spark_type) if c.name not in given else self._bumped(df, c.name, c.spark_type)
        return df.select("__i", *[F.col(f"`{c.name}`") for c in t.stored])

    def _numbered(self, df: DataFrame, name: str, kind: str) -> DataFrame:
        """``name`` counted from the table's next id in the order of __i, whose upper bits are a partition's number.

        Only the row count of each partition comes to the driver, so an INSERT … SELECT of any size stays dealt out.
        """
        part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND((1 << 33) - 1)
        counts = df.groupBy(part.alias("p")).agg((F.max(place) + 1).alias("n")).collect()
        start, starts = self.t.auto_next, []
        for r in sorted(counts, key=lambda r: r["p"]):
            starts.append((r["p"], start))
            start += r["n"]
        offsets = self.spark.createDataFrame(starts, "__p long, __start long")
        df = df.withColumn("__p", part).join(F.broadcast(offsets), "__p")
        return df.withColumn(name, (F.col("__start") + place).cast(kind)).drop("__p", "__start")

    def _bumped(self, df: DataFrame, name: str, kind: str) -> DataFrame:
        """Given ids stay, and a larger one bumps those counted after it.

        An id is the highest start so far plus the ids counted so far. Both run on within the parts of __i whose upper
        bits are alike; of each part only its count and its highest bump come to the driver, which chains them.
        """
        value = F.when(F.col(name) == 0, None).otherwise(F.col(name))
        df = shared(df.withColumn("__part", F.shiftright("__i", 33)).withColumn("__value", value))
        order = Window.partitionBy("__part").orderBy("__i")
        n = F.sum(F.col("__value").isNull().cast("long")).over(order)
        df = df.withColumn("__n", n).withColumn("__top", F.max(F.col("__value") + 1 - F.col("__n")).over(order))
        parts = df.groupBy("__part").agg(F.max("__n").alias("n"), F.max("__top").alias("top")).collect()
        start, counted, rows = self.t.auto_next, 0, []
        for r in sorted(parts, key=lambda r: r["__part"]):
            rows.append((r["__part"], start, counted))
            # Bumps of a part are relative to the ids counted before it.
            start = max(start, (r["top"] - counted) if r["top"] is not None else start)
            counted += r["n"]
        before = self.spark.createDataFrame(rows, "__part long, __start long, __counted long")
        df = df.join(F.broadcast(before), "__part")
        start = F.greatest("__start", F.coalesce(F.col("__top") - F.col("__counted"), F.col("__start")))
        made = F.coalesce("__value", start + F.col("__counted") + F.col("__n") - 1)
        return df.withColumn(name, made.cast(kind)).drop("__part", "__value", "__n", "__top", "__start", "__counted")

    def _bump(self, df: DataFrame, generated: bool) -> None:
        auto = next((c.name for c in self.t.stored if c.auto_increment), None)
        if auto:
            row = df.agg(F.max(auto).alias("hi"), F.min(F.when(F.col(auto) >= self.t.auto_next, F.col(auto))).alias("lo")).first()
            if generated and row["lo"] is not None:
                self.first_id = row["lo"]
            self.t.auto_next = max(self.t.auto_next, (row["hi"] or 0) + 1)

    def insert(self, rows: DataFrame, given: list[str], mode: str = "plain", assignments: dict[str, str] | None = None, alias: str | None = None) -> int:
        """Insert ``rows`` (columns ``given`` and __i, the order). Modes: plain, ignore, replace, update. Returns rows affected."""
        t = self.t
        auto = next((c.name for c in t.stored if c.auto_increment), None)
        new = self.completed(rows, given).cache()
        try:
            keys = t.unique_keys()
            if mode == "plain" or not keys:
                self.check_rows(new)
                n = new.count()
                if keys:
                    self.check_unique(self.catalog.read(t).select(*[c.name for c in t.stored]).unionByName(new.drop("__i")))
                self._bump(new, auto is not None and auto not in given)
                self.changes = [("INSERT", None, new.drop("__i"))]
                self.catalog.append(t, new.drop("__i"), n)
                return n
            if mode == "update":
                return self._upserted(new, keys, assignments or {})
            return self._skip(new, keys) if mode == "ignore" else self._replace(new, keys)
        finally:
            new.unpersist()

    def _first_of_each(self, df: DataFrame, keys, last: bool) -> DataFrame:
        for _, columns in keys:
            order = F.desc("__i") if last else F.asc("__i")
            some_null = F.lit(False)
            for c in columns:
                some_null = some_null | F.col(c).isNull()
            df = df.withColumn("__n", F.row_number().over(Window.partitionBy(*map(self.key, columns)).orderBy(order))).filter((F.col("__n") == 1) | some_null).drop("__n")
        return df

    def _conflicts(self, left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
        """``left`` semi- or anti-joined with ``right`` on any of the unique keys, one hash join for each."""
        if how == "left_anti":
            for _, columns in keys:
                left = self._matched(left, right, columns, how)
            return left
        parts = [self._matched(left, right, columns, how) for _, columns in keys]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(list(keys[0][1])) if len(parts) > 1 else out

    def _matched(self, left: DataFrame, right: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
        taken = right.select(*[self.key(c).alias(f"__k{i}") for i, c in enumerate(columns)]).distinct()
        return left.join(taken, [self.key(c) == F.col(f"__k{i}") for i, c in enumerate(columns)], how)

    def _skip(self, new: DataFrame, keys) -> int:
        rows = self._conflicts(self._first_of_each(new, keys, False), self.catalog.read(self.t), keys, "left_anti").cache()
        self.check_rows(rows)
        n = rows.count()
        self._bump(rows, False)
        self.changes = [("INSERT", None, rows.drop("__i"))]
        self.catalog.append(self.t, rows.drop("__i"), n)
        rows.unpersist()
        return n

    def _replace(self, new: DataFrame, keys) -> int:
        old = self.catalog.read(self.t).select(*[c.name for c in self.t.stored])
        rows = self._first_of_each(new, keys, True)
        self.check_rows(rows)
        gone = self._conflicts(old, rows, keys, "left_semi")
        self.check_children(gone)
        deleted = gone.count() + new.count() - rows.count()
        self._bump(new, False)
        self.changes = [("DELETE", gone, None), ("INSERT", None, rows.drop("__i"))]
        self.catalog.replace(self.t, self._conflicts(old, rows, keys, "left_anti").unionByName(rows.drop("__i")))
        return new.count() + deleted

    def _upserted(self, new: DataFrame, keys, assignments: dict[str, str]) -> int:
        """Upserts in rounds: a later row sees what earlier ones did, so of the rows that share a key one is applied at a time.

        There are as many rounds as rows share one key, and each is a joined write over the whole table.
        """
        total, rest, changes = 0, new, []
        while True:
            first = rest
            for k, (_, columns) in enumerate(keys):
                place = F.row_number().over(Window.partitionBy(*map(self.key, columns)).orderBy("__i"))
                full = ~F.greatest(*[F.col(c).isNull() for c in (*columns, *columns)])
                first = first.withColumn(f"__n{k}", F.when(full, place).otherwise(1))
            ready = F.lit(True)
            for k in range(len(keys)):
                ready = ready & (F.col(f"__n{k}") == 1)
            marked = shared(first.withColumn("__ready", ready).drop(*[f"__n{k}" for k in range(len(keys))]))
            now, rest = marked.filter("__ready").drop("__ready"), marked.filter("not __ready").drop("__ready")
            total += self._upsert(now, keys, assignments)
            changes += self.changes
            if not rest.take(1):
                self.changes = changes
                return total

    def _upsert(self, new: DataFrame, keys, assignments: dict[str, str]) -> int:
        """1 for an insert, 2 for a change, 0 for a row that stays as it is. No two of ``new`` share a key.

        A row changes the one that has its first unique key that is taken, in the order of the keys.
        """
        t = self.t
        names = [c.name for c in t.stored]
        self.check_rows(new)
        old = shared(self.catalog.read(t).select(*names).withColumn("__rid", F.monotonically_increasing_id()))
        incoming = new.select("__i", *[F.col(n).alias(f"__new_{n}") for n in names])
        hits = None
        for k, (_, columns) in enumerate(keys):
            side = old.select("__rid", *[F.col(c).alias(f"__old_{c}") for c in columns])
            hit = incoming.join(side, [self.key(c, "__new_") == self.key(c, "__old_") for c in columns]).select("__i", F.lit(k).alias("k"), "__rid")
            hits = hit if hits is None else hits.unionByName(hit)
        targets = shared(hits.groupBy("__i").agg(F.min(F.struct("k", "__rid")).alias("t")).select("__i", F.col("t.__rid").alias("__rid")))
        if targets.groupBy("__rid").count().filter("count > 1").take(1):
            # Two rows meet one old row through different keys: the earlier ones of each old row go first.
            late = targets.withColumn("n", F.row_number().over(Window.partitionBy("__rid").orderBy("__i"))).filter("n > 1").select("__i")
            late = shared(late)
            bound = late.agg(F.min("__i")).first()[0]
            total = self._upsert(new.filter(F.col("__i") < bound), keys, assignments)
            changes = self.changes
            total += self._upsert(new.filter(F.col("__i") >= bound), keys, assignments)
            self.changes = changes + self.changes
            return total
        joined = old.join(targets.join(incoming, "__i"), "__rid", "left")
        hit = F.col("__i").isNotNull()
        up = {f"__up_{n}": F.when(hit, F.expr(assignments[n])).otherwise(F.col(n)).cast(t.column(n).spark_type) if n in assignments else F.col(n) for n in names}
        merged = joined.withColumns(up)
        differs = F.lit(False)
        for n in names:
            differs = differs | ~F.col(n).eqNullSafe(F.col(f"__up_{n}"))
        changed = merged.filter(hit & differs)
        n_changed = changed.count()
        added = new.join(targets.select("__i"), "__i", "left_anti").select(*names)
        n_added = added.count()
        updated = coerced(t, changed.select(*[F.col(f"__up_{n}").alias(n) for n in names]))
        if n_changed:
            self.check_rows(updated)
            self.check_moved(changed, set(assignments))
        whole = coerced(t, merged.select(*[F.col(f"__up_{n}").alias(n) for n in names])).unionByName(added)
        if len(keys) > 1 or any(c in assignments for _, columns in keys for c in columns):
            self.check_unique(whole)
        self._bump(added, False)
        self.changes = [("INSERT", None, added), ("UPDATE", changed.select(*names), updated)]
        self.catalog.replace(t, whole)
        return n_added + 2 * n_changed

    def check_moved(self, changed: DataFrame, assigned: set[str]) -> None:
        """Error 1451 where a column that another table refers to changes (``changed`` has __up_ columns) under a child."""
        parents = sorted({p for other in self.catalog.databases[self.db].values() for fk in other.foreign_keys if fk.parent.lower() == self.t.name.lower() for p in fk.parent_columns})
        if assigned.intersection(parents):
            moved = F.lit(False)
            for k in parents:
                moved = moved | ~F.col(k).eqNullSafe(F.col(f"__up_{k}"))
            self.check_children(changed.filter(moved).select(*[c.name for c in self.t.stored]))

    def update(self, assignments: dict[str, str], where: str | None, matched: DataFrame | None = None) -> int:
        """Set columns where ``where`` holds, or in the rows that ``matched`` has by primary key with columns __set_*."""
        t = self.t
        names = [c.name for c in t.stored]
        for n in assignments:
            if t.column(n).generated is not None:
                raise EngineError(3105, f"The value specified for generated column '{n}' is not allowed.")
        full = self.catalog.visible(t, {c.name.lower() for c in t.columns})
        if matched is not None:
            full = full.join(matched.select(*[F.col(k).alias(f"__key_{k}") for k in t.primary_key], *[f"__set_{n}" for n in assignments]), [F.col(k) == F.col(f"__key_{k}") for k in t.primary_key], "left")
            hit = F.col(f"__key_{t.primary_key[0]}").isNotNull()
            values = {n: F.col(f"__set_{n}") for n in assignments}
        else:
            hit = F.coalesce(F.expr(where).cast("boolean"), F.lit(False)) if where else F.lit(True)
            values = {n: F.expr(sql) for n, sql in assignments.items()}
        # What is compared is collated, what is stored is not.
        full = full.withColumns({"__hit": hit, **{f"__val_{n}": value.cast(t.column(n).spark_type) for n, value in values.items()}})
        full = full.withColumns({n: F.col(n).cast(t.column(n).spark_type) for n in names})
        full = full.withColumns({f"__up_{n}": F.when(F.col("__hit"), F.col(f"__val_{n}")).otherwise(F.col(n)) if n in values else F.col(n) for n in names})
        differs = F.lit(False)
        for n in names:
            differs = differs | ~F.col(n).eqNullSafe(F.col(f"__up_{n}"))
        changed = full.filter(F.col("__hit") & differs)
        n = changed.count()
        after = changed.select(*[F.col(f"__up_{x}").alias(x) for x in names])
        after = coerced(t, after)
        self.check_rows(after)
        self.check_moved(changed, set(assignments))
        whole = coerced(t, full.select(*[F.col(f"__up_{x}").alias(x) for x in names]))
        if any(c in assignments for _, columns in t.unique_keys() for c in columns):
            self.check_unique(whole)
        self.changes = [("UPDATE", changed.select(*names), after)]
        if n:
            self.catalog.replace(t, whole)
        return n

    def delete(self, where: str | None, matched: DataFrame | None = None) -> int:
        t = self.t
        names = [c.name for c in t.stored]
        full = self.catalog.visible(t, {c.name.lower() for c in t.columns})
        if matched is not None:
            keys = list(t.primary_key)
            gone = full.join(matched.select(*keys).distinct(), keys, "left_semi").select(*names)
            stay = full.join(matched.select(*keys).distinct(), keys, "left_anti").select(*names)
        else:
            hit = F.coalesce(F.expr(where).cast("boolean"), F.lit(False)) if where else F.lit(True)
            gone, stay = full.filter(hit).select(*names), full.filter(~hit).select(*names)
        gone, stay = (x.withColumns({c: F.col(c).cast(t.column(c).spark_type) for c in names}) for x in (gone, stay))
        n = gone.count()
        self.check_children(gone)
        self.changes = [("DELETE", gone, None)]
        if n:
            self.catalog.replace(t, stay)
        return n
