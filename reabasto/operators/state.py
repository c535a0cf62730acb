"""State tables: manual entries, recurring rules, audit log, notifications.

Each operator takes the current table and gives the new one; nothing is changed in place.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto import schemas as S
from reabasto.functions.columns import any_of, is_true, is_yes, side_by_side
from reabasto.operators.manual import is_active
from reabasto.operators.serving import (
    PAIR,
    SEARCHED,
    Filters,
    filter_suggestions,
    page_of,
    units_from_days,
)
from reabasto.params import Params


def expire_at(day: Column, params: Params) -> Column:
    """Start of the next day in the business zone, as UTC wall time, whatever zone the session has."""
    begins = F.date_add(day, 1).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(params.business_zone), F.lit("UTC"), begins)


def expiry_accepted(day: Column, today: date, params: Params) -> Column:
    return (day >= F.lit(today)) & (F.year(day) <= params.max_expiry_year)


def bulk_manual(
    rows: DataFrame,
    f: Filters,
    params: Params,
    batch: str,
    now: datetime,
    user: str,
    units: int | None = None,
    days: int | None = None,
    reason: str | None = None,
    expires: datetime | None = None,
) -> DataFrame:
    """One manual entry per filtered pair, all under one batch id. With stock days the units
    come from the pair's daily demand, and pairs without demand get none."""
    if not units and not days:
        raise ValueError("units or days are needed")
    pairs = filter_suggestions(rows, f, params)
    sized = units_from_days(pairs, days) if days else pairs.withColumn("unidades", F.lit(units).cast("long"))
    text = F.lit(None).cast("string")
    return sized.select(
        F.concat_ws(":", F.lit(batch), "producto", "sucursal_id").alias("id"),
        *PAIR,
        "unidades",
        F.lit(reason).cast("string").alias("motivo"),
        F.lit(user).alias("creado_por"),
        F.lit(now).alias("creado_en"),
        F.lit(False).alias("archivada"),
        text.alias("recurrente_id"),
        F.lit(batch).alias("lote_id"),
        F.lit(expires).cast("timestamp").alias("expira_en"),
    )


def bulk_counts(rows: DataFrame, f: Filters, params: Params, days: int | None = None) -> DataFrame:
    """Entries a bulk load creates and pairs it leaves out."""
    kept = F.lit(True) if days is None else is_true(F.col("demanda_diaria") > 0)
    return filter_suggestions(rows, f, params).agg(
        F.count_if(kept).alias("creadas"), F.count_if(~kept).alias("omitidas")
    )


def drop_batch(manual: DataFrame, batch: str) -> DataFrame:
    """Without the batch's entries; those a recurring rule made stay."""
    gone = is_true(F.col("lote_id") == batch) & F.col("recurrente_id").isNull()
    return manual.filter(~gone)


def change_log(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, cambio, detalle): rows added, removed, and changed with `field: old -> new`."""
    before = old.select(F.col(key), F.struct(*columns).alias("a"))
    after = new.select(F.col(key), F.struct(*columns).alias("d"))

    def shown(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit("None"))

    changed = [
        F.when(
            ~F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}")),
            F.concat(F.lit(f"{c}: "), shown("a", c), F.lit(" -> "), shown("d", c)),
        )
        for c in columns
    ]
    both = before.join(after, key, "full").withColumn(
        "detalle",
        F.when(
            F.col("a").isNotNull() & F.col("d").isNotNull(),
            F.array_join(F.array_compact(F.array(*changed)), "; "),
        ),
    )
    kind = (
        F.when(F.col("a").isNull(), "agregada")
        .when(F.col("d").isNull(), "eliminada")
        .otherwise("modificada")
    )
    return both.select(key, kind.alias("cambio"), "detalle").filter(
        F.col("detalle").isNull() | (F.col("detalle") != "")
    )


def list_manual(
    manual: DataFrame,
    product: str | None = None,
    branch: str | None = None,
    archived: bool = False,
    only_single: bool = False,
) -> DataFrame:
    kept = manual
    if product:
        kept = kept.filter(F.col("producto") == product)
    if branch:
        kept = kept.filter(F.col("sucursal_id") == branch)
    if not archived:
        kept = kept.filter(~is_true(F.col("archivada")))
    if only_single:
        kept = kept.filter(F.col("recurrente_id").isNull())
    return kept.orderBy(F.col("creado_en").desc(), "id")


def manual_batches(manual: DataFrame) -> DataFrame:
    """One row per batch, newest first."""
    return (
        manual.filter(F.col("lote_id").isNotNull())
        .groupBy("lote_id")
        .agg(
            F.count(F.lit(1)).alias("entradas"),
            F.sum("unidades").alias("unidades"),
            F.max("creado_en").alias("creado_en"),
        )
        .orderBy(F.col("creado_en").desc(), "lote_id")
    )


def single_entries(manual: DataFrame) -> DataFrame:
    return manual.filter(F.col("lote_id").isNull()).orderBy(F.col("creado_en").desc(), "id")


def active_entries(
    manual: DataFrame, now: datetime, product: str | None = None, branch: str | None = None, n: int | None = None
) -> DataFrame:
    """Manual entries in force for a product or branch, newest first; all, or the first `n` asked for."""
    kept = list_manual(manual.filter(is_active(now)), product, branch)
    return kept if n is None else kept.limit(n)


def active_rules(
    rules: DataFrame, product: str | None = None, branch: str | None = None, n: int | None = None
) -> DataFrame:
    """Active rules by id; all, or the first `n` asked for."""
    kept = rules.filter(is_true(F.col("activa")))
    if product:
        kept = kept.filter(F.col("producto") == product)
    if branch:
        kept = kept.filter(F.col("sucursal_id") == branch)
    kept = kept.orderBy("id")
    return kept if n is None else kept.limit(n)


def due_rules(rules: DataFrame, today: date) -> DataFrame:
    """Active rules whose turn has come and whose end has not passed."""
    end = F.col("fecha_fin")
    return rules.filter(
        is_true(F.col("activa"))
        & (F.col("proxima_ejecucion") <= F.lit(today))
        & (end.isNull() | (end >= F.lit(today)))
    )


def advance_rules(rules: DataFrame, today: date) -> DataFrame:
    """New rule table: run rules move to their first date after today, and stop when that
    lies past their end; rules past their end stop without running."""
    end, following = F.col("fecha_fin"), F.col("proxima_ejecucion")
    due = is_true(F.col("activa") & (following <= F.lit(today)))
    over = is_true(end < F.lit(today))
    runs = due & ~over
    step = F.col("cada_dias")
    steps = (F.floor(F.datediff(F.lit(today), following) / step) + 1).cast("int")
    return (
        rules.withColumns({"_corre": runs, "_corta": due & over})
        .withColumn(
            "proxima_ejecucion",
            F.when(F.col("_corre"), F.date_add(following, steps * step)).otherwise(following),
        )
        .withColumn(
            "activa",
            F.when(F.col("_corta"), F.lit(False))
            .when(F.col("_corre") & is_true(F.col("proxima_ejecucion") > end), F.lit(False))
            .otherwise(F.col("activa")),
        )
        .withColumn(
            "ultima_ejecucion",
            F.when(F.col("_corre"), F.lit(today)).otherwise(F.col("ultima_ejecucion")),
        )
        .drop("_corre", "_corta")
    )


ANY = "*"
# Filter lists that rules and rows are joined on, and the column each one names.
KEYED = {"sucursales": "nombre_sucursal", "filtro1": "filtro1_final", "abc": "clasificacion_abc"}


def _rule_accepts(params: Params) -> Column:
    """The filters of `filter_suggestions` that are not joined on, wanted values in `f.*`."""
    def holds(text: Column) -> Column:
        return F.concat(F.lit("%"), F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("%"))

    searching = is_true(F.trim("f.q") != "")
    hit = any_of(is_true(F.ilike(F.col(c), holds(F.col("f.q")))) for c in SEARCHED)

    def listed(name: str, column: str) -> Column:
        wanted = F.col(f"f.{name}")
        return ~is_true(F.size(wanted) > 0) | is_true(F.array_contains(wanted, F.col(column)))

    supplier = F.col("f.proveedor")
    named = is_true(F.ilike(F.col("proveedor"), holds(supplier)))
    view = F.lower(F.coalesce("f.vista", F.lit("todas")))
    at_cd = F.col("sucursal_id") == params.cd_id
    via_cd = is_true(is_yes(F.col("abastece_cd")))
    moves = is_true(F.col("sugerido_traslado") > 0) | is_true(F.col("total_sugerido_suc") > 0)
    shown = (
        F.when(view == "sucursales", ~at_cd & ~via_cd)
        .when(view == "cd", at_cd)
        .when(view == "distribucion", ~at_cd & via_cd & moves)
        .otherwise(True)
    )
    ordered = ~F.coalesce("f.solo_pedir", F.lit(True)) | is_true(F.lower("pedir") == "si")
    national = ~is_true(F.col("f.solo_nacionales")) | ~is_true(F.col("es_importado"))
    return (
        listed("tipo_origen", "tipo_origen")
        & listed("proveedores", "proveedor")
        & (~is_true(supplier != "") | named)
        & F.when(searching, hit).otherwise(ordered & national & shown)
    )


KEY_ROWS = 200_000  # rows of a join key that one task takes


def _group_targets(rules: DataFrame, rows: DataFrame, params: Params) -> DataFrame:
    """Pairs of each group rule.

    Rules meet rows by equality on those of branch, brand and class that the rule names. A row
    stands once for each combination of named columns that some rule has, mostly one or two of
    the eight. Rows are counted by key first; those of a key with more than KEY_ROWS are dealt by their
    pair into as many parts as that takes, and its rules are repeated for each. So a rule
    that names nothing meets all rows without a part that grows with them.
    """
    wanted = rules.filter(F.col("modo") != "individual").select(
        F.col("id").alias("recurrente_id"),
        "modo",
        F.col("motivo").alias("motivo"),
        F.col("unidades").alias("unidades_regla"),
        "dias_inventario",
        F.from_json(F.coalesce("filtros", F.lit("{}")), S.FILTERS).alias("f"),
    )

    def closed(name: str) -> Column:
        return is_true(F.size(F.col(f"f.{name}")) > 0)

    code = reduce(add, [F.when(closed(n), 1 << i).otherwise(0) for i, n in enumerate(KEYED)])
    wanted = wanted.withColumn("_code", code)
    used = wanted.agg(F.collect_set("_code")).scalar()
    placed = wanted
    keyed = filter_suggestions(rows, Filters(solo_pedir=False), params).withColumn("_code", F.explode(used))
    for i, (name, column) in enumerate(KEYED.items()):
        values = F.when(closed(name), F.array_distinct(F.col(f"f.{name}"))).otherwise(F.array(F.lit(ANY)))
        placed = placed.withColumn(f"_{name}", F.explode(values))
        named = F.col("_code").bitwiseAND(F.lit(1 << i)) != 0
        keyed = keyed.withColumn(f"_{name}", F.when(named, F.col(column)).otherwise(ANY))
    key = ["_code", *[f"_{name}" for name in KEYED]]
    return _met(keyed, placed, key).filter(_rule_accepts(params))


def key_parts(keyed: DataFrame, key: list[str], most: int) -> DataFrame:
    """Keys with more than `most` rows, and the number of parts they need; fewer rows than keyed / most."""
    counted = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return counted.select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_partes"))


def _met(keyed: DataFrame, placed: DataFrame, key: list[str], most: int = KEY_ROWS) -> DataFrame:
    """The join by key, large keys in parts."""
    parts, count = key_parts(keyed, key, most), F.coalesce("_partes", F.lit(1))
    dealt = keyed.join(parts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*PAIR), count).cast("int")).drop("_partes")
    repeated = placed.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("_partes")
    return dealt.join(repeated, [*key, "_salt"])


def recurring_entries(
    rules: DataFrame, rows: DataFrame, today: date, now: datetime, params: Params
) -> DataFrame:
    """Manual entries the due rules create: the rule's units, or its stock days times the
    current daily demand; pairs without demand are left out of day rules. A group rule of no
    units makes its entries all the same, a single one doesn't."""
    due = due_rules(rules, today)
    single = due.filter(F.col("modo") == "individual").select(
        F.col("id").alias("recurrente_id"),
        "modo",
        "motivo",
        F.col("unidades").alias("unidades_regla"),
        "dias_inventario",
        *PAIR,
    )
    columns = ["recurrente_id", "modo", "motivo", "unidades_regla", "dias_inventario", *PAIR, "demanda_diaria"]
    demand = rows.select(*PAIR, "demanda_diaria")
    targets = (
        single.join(demand, list(PAIR), "left")
        .select(*columns)
        .unionByName(_group_targets(due, rows, params).select(*columns))
    )
    by_days = is_true(F.col("dias_inventario") > 0)
    computed = F.greatest(
        F.lit(1), F.ceil(F.col("demanda_diaria") * F.col("dias_inventario"))
    ).cast("long")
    units = F.when(
        by_days, F.when(F.col("demanda_diaria") > 0, computed)
    ).otherwise(F.col("unidades_regla"))
    text = F.lit(None).cast("string")
    return (
        targets.withColumn("unidades", units)
        .filter((F.col("unidades") > 0) | ((F.col("modo") != "individual") & ~by_days & F.col("unidades").isNotNull()))
        .select(
            F.concat_ws(":", "recurrente_id", F.lit(str(today)), *PAIR).alias("id"),
            *PAIR,
            "unidades",
            "motivo",
            F.lit("recurrente").alias("creado_por"),
            F.lit(now).alias("creado_en"),
            F.lit(False).alias("archivada"),
            "recurrente_id",
            text.alias("lote_id"),
            F.lit(None).cast("timestamp").alias("expira_en"),
        )
    )


def archive_previous(manual: DataFrame, rules: DataFrame, today: date) -> DataFrame:
    """Entries the due rules made before, archived."""
    running = due_rules(rules, today).select(F.col("id").alias("recurrente_id")).distinct()
    return (
        manual.join(running.withColumn("_corre", F.lit(True)), "recurrente_id", "left")
        .withColumn("archivada", F.col("archivada") | is_true(F.col("_corre")))
        .select(*manual.columns)
    )


def process_recurring(
    rules: DataFrame,
    manual: DataFrame,
    rows: DataFrame,
    today: date,
    now: datetime,
    params: Params,
) -> tuple[DataFrame, DataFrame]:
    """New rule table and new manual table after one daily run."""
    created = recurring_entries(rules, rows, today, now, params)
    kept = archive_previous(manual, rules, today)
    return advance_rules(rules, today), kept.unionByName(created)


def recurring_counts(
    rules: DataFrame, rows: DataFrame, today: date, now: datetime, params: Params
) -> DataFrame:
    return side_by_side(
        {
            "recurrencias_procesadas": due_rules(rules, today),
            "sugerencias_creadas": recurring_entries(rules, rows, today, now, params),
        }
    )


def _event(action: str, kind: str, now: datetime) -> list[Column]:
    return [
        F.lit(action).alias("accion"),
        F.lit(kind).alias("entidad"),
        F.lit("cron").alias("usuario_email"),
        F.lit(now).alias("creado_en"),
    ]


def recurring_events(
    rules: DataFrame, rows: DataFrame, today: date, now: datetime, params: Params
) -> DataFrame:
    """One audit event per rule that ran, with the number of entries it made."""
    made = (
        recurring_entries(rules, rows, today, now, params)
        .groupBy(F.col("recurrente_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    count = F.coalesce("n", F.lit(0)).cast("string")
    return due_rules(rules, today).join(made, "id", "left").select(
        *_event("recurrente_aplicada", "sugerencia_recurrente", now),
        F.col("id").alias("entidad_id"),
        *PAIR,
        "unidades",
        "dias_inventario",
        F.concat(F.lit("Ejecucion automatica: "), count, F.lit(" instancia(s) creada(s)")).alias("detalle"),
    )


def expired_event(manual: DataFrame, now: datetime) -> DataFrame:
    """The audit event of a cleaning run; none when nothing had expired."""
    counted = count_expired(manual, now).filter("archivadas > 0")
    text = F.concat(
        F.lit("Vencimiento automatico: "), F.col("archivadas").cast("string"), F.lit(" sugerencia(s) manual(es) archivada(s)")
    )
    return counted.select(*_event("expiradas_archivadas", "sugerencia_manual", now), text.alias("detalle"))


def archive_expired(manual: DataFrame, now: datetime) -> DataFrame:
    """Entries past their limit archived; `count_expired` tells how many that are."""
    return manual.withColumn("archivada", F.col("archivada") | _has_expired(now))


def _has_expired(now: datetime) -> Column:
    return is_true(~is_true(F.col("archivada")) & (F.col("expira_en") <= F.lit(now)))


def count_expired(manual: DataFrame, now: datetime) -> DataFrame:
    return manual.agg(F.count_if(_has_expired(now)).alias("archivadas"))


def audit_rows(log: DataFrame, action: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    kept = log if action is None else log.filter(F.col("accion") == action)
    return kept.filter(~F.col("accion").isin(*without)) if without else kept


def audit_page(
    log: DataFrame,
    action: str | None = None,
    without: tuple[str, ...] = (),
    page: int = 1,
    limit: int = 100,
) -> DataFrame:
    keys = [F.col("creado_en").desc(), F.col("id").desc()]
    return page_of(audit_rows(log, action, without), keys, page, limit)


def audit_after(
    log: DataFrame,
    last: tuple[datetime, int] | None = None,
    action: str | None = None,
    without: tuple[str, ...] = (),
    limit: int = 100,
) -> DataFrame:
    """The page of `audit_page` that follows a page whose last event has this time and id; a page deep down costs no more than the first."""
    kept = audit_rows(log, action, without)
    if last is not None:
        when, number = F.lit(last[0]), F.lit(last[1])
        kept = kept.filter((F.col("creado_en") < when) | ((F.col("creado_en") == when) & (F.col("id") < number)))
    return kept.orderBy(F.col("creado_en").desc(), F.col("id").desc()).limit(limit)


def audit_total(log: DataFrame, action: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """How many events all pages of `audit_page` hold."""
    return audit_rows(log, action, without).agg(F.count(F.lit(1)).alias("total"))


def last_event(log: DataFrame, action: str) -> DataFrame:
    """Time and detail of the newest event of a kind, such as the last synchronisation."""
    newest = F.max(F.struct("creado_en", "id", "detalle"))
    return log.filter(F.col("accion") == action).agg(newest.alias("u")).select("u.creado_en", "u.detalle")


def readers(text: Column) -> Column:
    """Comma text to the set of its filled names."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda n: F.trim(n))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def notifications(
    events: DataFrame, user: str, only_unread: bool = False, limit: int = 50
) -> DataFrame:
    """The newest `limit` notifications with `leida`, of all or of the unread ones."""
    marked = events.withColumn("leida", F.array_contains(readers(F.col("vistas_por")), user))
    if only_unread:
        marked = marked.filter(~F.col("leida"))
    return marked.orderBy(F.col("creado_en").desc(), F.col("id").desc()).limit(limit)


def unread_count(events: DataFrame, user: str) -> DataFrame:
    seen = F.array_contains(readers(F.col("vistas_por")), user)
    return events.agg(F.count_if(~seen).alias("no_leidas"))


def mark_read(events: DataFrame, user: str, ids: list[str] | None = None) -> DataFrame:
    """The user added to the readers of all events, or of the given ones."""
    chosen = F.lit(True) if not ids else F.col("id").isin(*ids)
    seen = readers(F.col("vistas_por"))
    added = F.array_join(F.array_sort(F.array_union(seen, F.array(F.lit(user)))), ",")
    return events.withColumn(
        "vistas_por",
        F.when(chosen & ~F.array_contains(seen, user), added).otherwise(F.col("vistas_por")),
    )
