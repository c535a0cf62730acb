"""The calculation engine restated in SQL, one table expression per rule."""

from __future__ import annotations

from oracles.common import rounded, statement

BORDER = "(l_linestatus = 'O' AND s_nationkey % 5 = 0)"
MONTHS = "'200011','200012','200101','200102','200103','200104','200105','200106','200107','200108','200109','200110'"


def klass(short: str, mid: str, long: str) -> str:
    return (
        f"CASE WHEN {mid} >= 5 THEN 'A' WHEN {mid} = 4 THEN 'B' "
        f"WHEN {mid} = 3 AND {short} >= 2 THEN 'C' "
        f"WHEN {long} > 6 AND {mid} = 3 AND {short} < 2 THEN 'C' ELSE 'D' END"
    )


def capped(source: str, keys: str) -> str:
    """Mean and deviation of the capped series of `source` (keys, total)."""
    return f"""
      SELECT {keys}, avg(t) AS media, stddev_samp(t) AS desv FROM (
        SELECT {keys}, CASE WHEN mad = 0 THEN total ELSE least(total, med + 3.0 * 1.4826 * mad) END AS t
        FROM (SELECT *, median(abs(total - med)) OVER (PARTITION BY {keys}) AS mad
              FROM (SELECT *, median(total) OVER (PARTITION BY {keys}) AS med FROM {source})))
      GROUP BY {keys}"""


def lead_days(keys: str, source: str) -> str:
    """Mean days under the percentile cut, by keys, null keys as groups."""
    first, *rest = keys.split(", ")
    same = " AND ".join(f"b.{k} IS NOT DISTINCT FROM c.{k}" for k in [first, *rest])
    return f"""
      SELECT {", ".join("b." + k for k in [first, *rest])}, avg(b.dias) AS dias, count(*) AS n
      FROM (SELECT * FROM {source} WHERE valida) b
      JOIN (SELECT {keys},
                   CASE WHEN count(*) FILTER (WHERE nac) > count(*) FILTER (WHERE otra)
                        THEN quantile_cont(dias, 0.7) FILTER (WHERE valida)
                        ELSE quantile_cont(dias, 0.8) FILTER (WHERE valida) END AS corte
            FROM {source} GROUP BY {keys}) c
      ON {same}
      WHERE b.dias <= c.corte + 1e-9
      GROUP BY ALL"""


CTES = {
    "pt": "SELECT *, CAST(p_size AS VARCHAR) || ' ' || p_brand AS producto FROM part",
    "lin": """SELECT * FROM lineitem JOIN pt ON l_partkey = p_partkey
              JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "raw_main": f"""
      SELECT producto, n_name AS sucursal,
             CASE WHEN l_linenumber = 1 THEN 'VTA MOVIL' ELSE 'VTA MESON' END AS tipo_venta,
             CAST(l_shipdate AS DATE) AS fecha, CAST(l_quantity AS BIGINT) AS cantidad,
             CASE WHEN l_returnflag = 'R' THEN 'NC CLIENTE S/T' ELSE 'FACTURA' END AS documento,
             CASE WHEN l_linenumber = 7 THEN 'MO_ST' ELSE 'REPUESTOS' END AS tipoproducto, p_name
      FROM lin WHERE NOT {BORDER}""",
    "raw_border": f"""
      SELECT producto, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || ' ' || n_name AS sucursal,
             CAST(l_shipdate AS DATE) AS fecha, CAST(l_quantity AS BIGINT) AS cantidad,
             CASE WHEN l_returnflag = 'R' THEN 'NOTA CREDITO ST' WHEN l_returnflag = 'A' THEN 'FACTURA ST'
                  WHEN l_linenumber = 2 THEN 'FACTURA REPUESTOS (E)' ELSE 'CARGO INTERNO' END AS documento,
             CASE WHEN l_linenumber = 3 THEN 'Emision Pendiente' ELSE 'Emitido' END AS emitido,
             CASE WHEN l_linenumber = 7 THEN 'MO_ST' ELSE 'REPUESTO' END AS tipoproducto
      FROM lin WHERE {BORDER}""",
    "ventas_m": """
      SELECT producto, sucursal, tipo_venta, fecha,
             CASE WHEN documento = 'NC CLIENTE S/T' THEN -abs(cantidad) ELSE abs(cantidad) END AS cantidad,
             'Curifor' AS fuente
      FROM raw_main WHERE tipoproducto IN ('REPUESTOS', 'REPUESTO')""",
    "ventas_b": """
      SELECT producto, CASE WHEN sucursal = '00 NATION_0' THEN 'NATION_0' WHEN sucursal = '05 NATION_5' THEN 'NATION_5'
                            WHEN sucursal = '10 NATION_10' THEN 'NATION_10' WHEN sucursal = '15 NATION_15' THEN 'NATION_15'
                            ELSE sucursal END AS sucursal,
             'CLIENTE' AS tipo_venta, fecha, abs(cantidad) AS cantidad, 'Frontera' AS fuente
      FROM raw_border
      WHERE tipoproducto = 'REPUESTO' AND emitido = 'Emitido'
        AND documento IN ('CARGO INTERNO', 'FACTURA ST', 'NOTA CREDITO ST', 'REFACTURACION C/RS', 'REFACTURACION ST')""",
    "ventas": "SELECT * FROM ventas_m UNION ALL SELECT * FROM ventas_b",
    "mapeo": """
      SELECT DISTINCT producto, CAST(min(p_size) OVER (PARTITION BY p_brand) AS VARCHAR) || ' ' || p_brand AS master
      FROM pt WHERE CAST(substr(p_brand, 7) AS INTEGER) % 2 = 1""",
    "dimp": "SELECT producto, min(p_type) AS categoria FROM pt GROUP BY producto",
    "dims": """
      SELECT n_name AS sucursal, 'Suc ' || n_name AS nombre, r_name AS region
      FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 19""",
    "seg": """
      SELECT s_suppkey % 3 AS o, producto, l_orderkey % 25 AS plaza,
             CASE s_suppkey % 3
               WHEN 0 THEN CASE WHEN l_orderkey % 25 <= 20 THEN 'NATION_' || (l_orderkey % 25) ELSE 'DESCONOCIDO' END
               WHEN 1 THEN CASE WHEN l_orderkey % 25 % 2 = 0 THEN 'NATION_' || (l_orderkey % 25) ELSE 'DESCONOCIDO' END
               ELSE CASE WHEN l_orderkey % 25 % 3 = 0 THEN 'NATION_' || (l_orderkey % 25) ELSE 'DESCONOCIDO' END END AS sucursal,
             CASE WHEN l_linenumber = 6 AND s_suppkey % 10 = 0 THEN NULL ELSE s_name END AS razon,
             CAST(o_orderdate AS DATE) AS fecha_oc,
             CASE WHEN s_suppkey % 3 < 2 THEN o_orderkey END AS noc,
             CASE s_suppkey % 3 WHEN 0 THEN 'Curifor Nacional' WHEN 1 THEN 'Curifor Importado' ELSE 'Frontera Nacional' END AS origen,
             CASE WHEN s_suppkey % 3 = 2 THEN NULL WHEN l_returnflag = 'A' THEN 'Reposicion'
                  WHEN l_returnflag = 'N' THEN 'REPOSICION' ELSE 'Compra calzada' END AS motivo,
             CAST(l_quantity AS BIGINT) AS cantidad,
             CASE WHEN o_orderstatus = 'P' THEN 'Pendiente' ELSE 'Cerrado' END AS estado_oc,
             CASE WHEN o_orderstatus = 'O' THEN 'PENDIENTE' ELSE 'Cerrado' END AS estado_doc,
             CAST(o_orderdate AS DATE) + 3 AS fecha_doc,
             CASE WHEN l_linenumber <> 2 THEN CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) END AS fecha_pe
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pt ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey""",
    "stk": """
      SELECT producto, n_name AS sucursal, CAST(greatest(l_quantity - 46, 0) AS BIGINT) AS stock FROM lin
      WHERE l_orderkey % 4 <> 0""",
    "stk_b": """
      SELECT producto, n_name AS sucursal, CAST(greatest(l_quantity - 46, 0) AS BIGINT) AS stock FROM lin
      WHERE l_orderkey % 4 = 0""",
    "imp": "SELECT DISTINCT producto FROM pt WHERE p_brand IN ('Brand#1', 'Brand#2')",
    "prep": """
      SELECT * FROM (
        SELECT v.*, coalesce(m.master, v.producto) AS pm, strftime(fecha, '%Y%m') AS mes,
               CASE WHEN (sucursal = 'NATION_7' AND tipo_venta = 'VTA MOVIL') OR sucursal IN ('NATION_23', 'NATION_24') THEN 'NATION_0'
                    WHEN sucursal = 'NATION_22' THEN 'NATION_21' ELSE sucursal END AS suc
        FROM ventas v LEFT JOIN mapeo m ON v.producto = m.producto)
      WHERE suc <> 'NATION_20' AND pm NOT IN ('7 Brand#24', '11 Brand#8')
        AND producto NOT IN (SELECT producto FROM dimp WHERE categoria = 'PROMO')""",
    "pos": "SELECT DISTINCT pm, suc, mes FROM prep WHERE cantidad > 0 AND mes >= '200011'",
    "m_loc": """
      SELECT pm, suc, count(*) FILTER (WHERE mes >= '200108') AS m3,
             count(*) FILTER (WHERE mes >= '200105') AS m6, count(*) AS m12 FROM pos GROUP BY pm, suc""",
    "m_agg": """
      SELECT pm, count(DISTINCT mes) FILTER (WHERE mes >= '200108') AS m3a,
             count(DISTINCT mes) FILTER (WHERE mes >= '200105') AS m6a, count(DISTINCT mes) AS m12a FROM pos GROUP BY pm""",
    "abc0": f"""
      SELECT *, {klass("m3", "m6", "m12")} AS cl, {klass("m3a", "m6a", "m12a")} AS ca FROM (
        SELECT c.pm, c.suc, coalesce(m3, 0) AS m3, coalesce(m6, 0) AS m6, coalesce(m12, 0) AS m12,
               coalesce(m3a, 0) AS m3a, coalesce(m6a, 0) AS m6a, coalesce(m12a, 0) AS m12a
        FROM (SELECT DISTINCT pm, suc FROM prep WHERE mes >= '200011') c
        LEFT JOIN m_loc l ON c.pm = l.pm AND c.suc = l.suc LEFT JOIN m_agg a ON c.pm = a.pm)""",
    "sint": """
      SELECT DISTINCT pm, 'NATION_0' AS suc, 0 AS m3, 0 AS m6, 0 AS m12, m3a, m6a, m12a, 'D' AS cl, ca FROM abc0
      WHERE pm IN (SELECT pm FROM abc0 WHERE cl IN ('C', 'D') AND ca IN ('A', 'B'))
        AND pm NOT IN (SELECT pm FROM abc0 WHERE suc = 'NATION_0')""",
    "abcx": "SELECT * FROM abc0 UNION ALL SELECT * FROM sint",
    "meses": f"SELECT unnest([{MONTHS}]) AS mes",
    "tot": "SELECT pm, suc, mes, sum(cantidad) AS total FROM prep GROUP BY pm, suc, mes",
    "serie12": """
      SELECT a.pm, a.suc, a.cl, x.mes, CAST(coalesce(t.total, 0) AS DOUBLE) AS total FROM abcx a CROSS JOIN meses x
      LEFT JOIN tot t ON a.pm = t.pm AND a.suc = t.suc AND x.mes = t.mes""",
    "serie_loc": "SELECT * FROM serie12 WHERE cl IN ('C', 'D') OR mes >= '200105'",
    "dem_loc": capped("serie_loc", "pm, suc"),
    "cd_ab": "SELECT pm FROM abcx WHERE suc = 'NATION_0' AND ca IN ('A', 'B')",
    "cons": """
      SELECT pm, 'NATION_0' AS suc FROM cd_ab
      UNION SELECT pm, suc FROM abcx WHERE suc <> 'NATION_0' AND cl IN ('C', 'D') AND pm IN (SELECT pm FROM cd_ab)""",
    "tot_cd": """
      SELECT t.pm, mes, sum(total) AS total FROM tot t JOIN cons c ON t.pm = c.pm AND t.suc = c.suc GROUP BY t.pm, mes""",
    "serie_cd": """
      SELECT c.pm, x.mes, CAST(coalesce(t.total, 0) AS DOUBLE) AS total FROM cd_ab c CROSS JOIN meses x
      LEFT JOIN tot_cd t ON c.pm = t.pm AND x.mes = t.mes""",
    "dem_cd": capped("serie_cd", "pm"),
    "dem": """
      SELECT a.pm, a.suc, CASE WHEN a.suc = 'NATION_0' THEN coalesce(c.media, l.media) ELSE l.media END AS media,
             CASE WHEN a.suc = 'NATION_0' THEN coalesce(c.desv, l.desv) ELSE l.desv END AS desv
      FROM abcx a LEFT JOIN dem_loc l ON a.pm = l.pm AND a.suc = l.suc LEFT JOIN dem_cd c ON a.pm = c.pm""",
    "oc": """
      SELECT razon, sucursal, dias,
             coalesce((origen <> 'Curifor Nacional' OR lower(motivo) = 'reposicion') AND (origen = 'Curifor Importado' OR dias < 30), false) AS valida,
             coalesce(origen = 'Curifor Nacional' AND lower(motivo) = 'reposicion' AND dias < 30, false) AS nac,
             origen <> 'Curifor Nacional' AS otra
      FROM (SELECT *, fecha_pe - fecha_oc AS dias FROM seg WHERE fecha_pe >= fecha_oc)""",
    "oc_suc": "SELECT * FROM oc WHERE sucursal <> 'DESCONOCIDO' AND razon IS NOT NULL",
    "lt_prov": lead_days("razon", "oc"),
    "lt_suc": lead_days("razon, sucursal", "oc_suc"),
    "segf": "SELECT * FROM seg WHERE razon IS NOT NULL AND (origen <> 'Curifor Nacional' OR lower(motivo) = 'reposicion')",
    "rec": """
      SELECT producto, sucursal, arg_max(razon, (fecha_oc, coalesce(noc, -1), razon)) AS reciente FROM segf GROUP BY producto, sucursal""",
    "prov": """
      SELECT a.pm, a.suc, r.reciente, coalesce(x1.p, x2.p, x3.p, x4.p) AS prov_lt FROM abcx a
      LEFT JOIN (SELECT producto, sucursal, arg_min(razon, (lower(razon), razon)) AS p FROM segf GROUP BY producto, sucursal) x1 ON x1.producto = a.pm AND x1.sucursal = a.suc
      LEFT JOIN (SELECT producto, arg_min(razon, (lower(razon), razon)) AS p FROM segf GROUP BY producto) x2 ON x2.producto = a.pm
      LEFT JOIN (SELECT producto, sucursal, arg_min(razon, (lower(razon), razon)) AS p FROM seg WHERE razon IS NOT NULL GROUP BY producto, sucursal) x3 ON x3.producto = a.pm AND x3.sucursal = a.suc
      LEFT JOIN (SELECT producto, arg_min(razon, (lower(razon), razon)) AS p FROM seg WHERE razon IS NOT NULL GROUP BY producto) x4 ON x4.producto = a.pm
      LEFT JOIN rec r ON r.producto = a.pm AND r.sucursal = a.suc""",
    "lt": """
      SELECT *, CASE WHEN abastece = 'Si' THEN CAST(lt_cd AS DOUBLE) ELSE lt_dias END AS lt_ef FROM (
        SELECT a.pm, a.suc, a.cl, a.ca, coalesce(p.reciente, p.prov_lt) AS proveedor, p.prov_lt,
               coalesce(s.dias, g.dias, 8.0) AS lt_dias,
               CASE WHEN s.dias IS NOT NULL THEN 'Por sucursal' WHEN g.dias IS NOT NULL THEN 'Global proveedor' ELSE 'Fallback 8 dias' END AS lt_origen,
               CASE WHEN a.suc = 'NATION_9' THEN 2 WHEN a.suc = 'NATION_5' THEN 1 WHEN d.region = 'AMERICA' THEN 1 ELSE 2 END AS lt_cd,
               i.producto IS NOT NULL AS importado,
               CASE WHEN i.producto IS NOT NULL OR (a.suc <> 'NATION_0' AND a.cl IN ('C', 'D') AND a.ca IN ('A', 'B')) THEN 'Si' ELSE 'No' END AS abastece
        FROM abcx a JOIN prov p ON a.pm = p.pm AND a.suc = p.suc
        LEFT JOIN lt_suc s ON s.razon = p.prov_lt AND s.sucursal = a.suc
        LEFT JOIN lt_prov g ON g.razon = p.prov_lt
        LEFT JOIN dims d ON d.sucursal = a.suc LEFT JOIN imp i ON i.producto = a.pm)""",
    "ss": """
      SELECT *, CAST(floor(z * desv * sqrt((lt_ef + co) / 22.0) + 0.5) AS BIGINT) AS ss FROM (
        SELECT l.*, d.media, d.desv, d.media / 22.0 AS dd, CASE WHEN abastece = 'Si' THEN 3 ELSE 5 END AS co,
               CASE WHEN abastece = 'Si' AND importado AND k = 'A' THEN 1.282::DOUBLE WHEN abastece = 'Si' AND importado AND k = 'B' THEN 1.036::DOUBLE
                    WHEN k = 'A' THEN 1.645::DOUBLE WHEN k = 'B' THEN 1.282::DOUBLE WHEN k = 'C' THEN 0.842::DOUBLE ELSE 0.0::DOUBLE END AS z
        FROM (SELECT *, CASE WHEN suc = 'NATION_0' THEN ca ELSE cl END AS k FROM lt) l
        JOIN dem d ON l.pm = d.pm AND l.suc = d.suc)""",
    "miembros": """
      SELECT DISTINCT pm, pm AS miembro FROM abcx
      UNION SELECT master, producto FROM mapeo WHERE master IN (SELECT pm FROM abcx)""",
    "todo_stk": "SELECT * FROM stk UNION ALL SELECT * FROM stk_b",
    "activo": """
      SELECT m.pm, s.sucursal AS suc, sum(s.stock) AS stock FROM miembros m JOIN todo_stk s ON s.producto = m.miembro GROUP BY ALL""",
    "transito": """
      SELECT producto AS pm, sucursal AS suc, sum(cantidad) AS stock FROM seg
      WHERE (lower(estado_oc) = 'pendiente' AND (
              (lower(origen) = 'curifor nacional' AND lower(motivo) = 'reposicion' AND DATE '2001-08-01' - fecha_oc <= 30)
              OR (lower(origen) = 'curifor importado' AND DATE '2001-08-01' - fecha_oc <= 180)))
         OR (lower(origen) = 'frontera nacional' AND lower(estado_doc) = 'pendiente' AND DATE '2001-08-01' - fecha_doc <= 30)
      GROUP BY ALL""",
    "sug": """
      SELECT *, CASE WHEN k IN ('A', 'B') THEN necesidad ELSE 0.0 END AS sugerido FROM (
        SELECT s.*, CASE WHEN suc = 'NATION_0' THEN ca ELSE cl END AS k,
               coalesce(sa, 0) AS activo, coalesce(st, 0) AS en_transito,
               greatest(floor(dd * (co + lt_ef) + coalesce(ss, 0) - coalesce(sa, 0) - coalesce(st, 0) + 0.5), 0.0) AS necesidad,
               floor(dd * lt_ef + coalesce(ss, 0) + 0.5) AS punto
        FROM (SELECT ss.*, a.stock AS sa, t.stock AS st FROM ss
              LEFT JOIN activo a ON a.pm = ss.pm AND a.suc = ss.suc
              LEFT JOIN transito t ON t.pm = ss.pm AND t.suc = ss.suc) s)""",
    "pri": """
      SELECT s.*, c.stock AS stock_cd, coalesce(p.prioridad, 99) AS prioridad,
             suc <> 'NATION_0' AND cl IN ('C', 'D') AND ca IN ('A', 'B') AS elegible
      FROM sug s LEFT JOIN (SELECT pm, stock FROM activo WHERE suc = 'NATION_0') c ON c.pm = s.pm
      LEFT JOIN (SELECT 'NATION_' || i AS suc2, i AS prioridad FROM range(1, 12) t(i)) p ON p.suc2 = s.suc""",
    "tr0": """
      SELECT *, sum(CASE WHEN elegible THEN necesidad ELSE 0 END) OVER (PARTITION BY pm ORDER BY prioridad, suc ROWS UNBOUNDED PRECEDING) AS acum FROM pri""",
    "tr1": """
      SELECT *, CASE WHEN elegible AND necesidad > 0 AND stock_cd > 0 AND least(necesidad, greatest(stock_cd - (acum - necesidad), 0)) > 0
                     THEN floor(least(necesidad, greatest(stock_cd - (acum - necesidad), 0))) END AS traslado,
             CASE WHEN elegible THEN CASE WHEN stock_cd IS NULL OR stock_cd <= 0 OR acum > stock_cd THEN 'Si' ELSE 'No' END END AS comprar_cd
      FROM tr0""",
    "lateral_txt": """
      SELECT s.pm, s.suc, string_agg(replace(format('{:,}', CAST(least(s.sugerido, a.stock) AS BIGINT)), ',', '.') || ' unidades desde ' || coalesce(d.nombre, a.suc),
                 '; ' ORDER BY a.stock DESC, CAST(substr(a.suc, 8) AS INTEGER)) AS texto
      FROM sug s JOIN activo a ON a.pm = s.pm AND a.suc <> s.suc AND a.stock > 0
      LEFT JOIN dims d ON d.sucursal = a.suc
      WHERE s.sugerido > 0 AND a.suc IN (SELECT 'NATION_' || i FROM range(1, 11) t(i)) GROUP BY ALL""",
    "tr": """
      SELECT t.*, CASE WHEN sugerido > 0 THEN floor(sugerido - coalesce(traslado, 0)) END AS neta, l.texto
      FROM tr1 t LEFT JOIN lateral_txt l ON l.pm = t.pm AND l.suc = t.suc""",
    "empresa": """
      SELECT pm, suc, CASE WHEN f AND NOT c THEN 'Solo Frontera' WHEN f THEN 'Ambas' ELSE 'Solo Curifor' END AS empresa
      FROM (SELECT pm, suc, bool_or(fuente = 'Frontera') AS f, bool_or(fuente = 'Curifor') AS c FROM prep GROUP BY pm, suc)""",
    "reem": "SELECT master AS pm, string_agg(producto, ', ' ORDER BY producto) AS reemplazos FROM mapeo WHERE producto <> master GROUP BY master",
    "origen_cd": """
      SELECT pm, string_agg(suc, ', ' ORDER BY suc) AS lista FROM abcx
      WHERE suc <> 'NATION_0' AND cl IN ('C', 'D') AND ca IN ('A', 'B') GROUP BY pm""",
    "cat": """
      SELECT producto, c.d AS descripcion, c.f AS filtro1, c.u AS unidad FROM (
        SELECT producto, min({'d': p_name, 'f': p_brand, 'u': p_type}) AS c FROM pt GROUP BY producto)""",
    "costo": """
      SELECT producto, max(p_retailprice) AS costo FROM (SELECT producto, round(p_retailprice, 2) AS p_retailprice FROM pt WHERE p_partkey % 10 <> 0) GROUP BY producto""",
    "con_cd": "SELECT DISTINCT producto FROM todo_stk WHERE sucursal = 'NATION_0' AND stock > 0",
}

PIVOT = ", ".join(
    f"max(stock) FILTER (WHERE suc = 'NATION_{k}') AS \"Stock NATION_{k}\"" for k in range(11)
)
CTES["pivote"] = f"SELECT pm, {PIVOT} FROM activo GROUP BY pm"
CTES["plan"] = f"""
  SELECT t.pm AS "Producto", c.descripcion AS "Descripcion", t.suc AS "SucursalID",
         coalesce(d.nombre, CASE WHEN t.suc = 'NATION_19' THEN 'Suc nineteen' END, t.suc) AS "Nombre Sucursal",
         CAST(a.m3 AS BIGINT) AS "Meses con Venta 3m", CAST(a.m6 AS BIGINT) AS "Meses con Venta 6m", CAST(a.m12 AS BIGINT) AS "Meses con Venta 12m",
         t.cl AS "Clasificacion ABC", t.ca AS "Clasificacion ABC Agregada", t.proveedor AS "Proveedor",
         round(t.lt_dias, 4) AS "Lead Time Dias", t.lt_origen AS "LT Origen", t.lt_cd AS "LT CD a Sucursal Dias",
         round(t.lt_ef, 4) AS "LT Efectivo", t.abastece AS "Abastece CD", CAST(t.prioridad AS INTEGER) AS "Prioridad CD",
         round(t.media, 6) AS "Demanda Mensual", round(t.desv, 6) AS "Desv Std Mensual", round(t.dd, 8) AS "Demanda Diaria",
         t.ss AS "Stock de Seguridad", round(k.costo, 4) AS "Costo Unitario",
         CASE WHEN t.importado THEN 'True' ELSE 'False' END AS "Es Importado",
         CASE WHEN cd.producto IS NOT NULL THEN 'True' ELSE 'False' END AS "Tiene Stock CD",
         c.filtro1 AS "FILTRO1_Final", c.unidad AS "Unidad de Medida",
         CASE WHEN t.suc = 'NATION_0' AND t.ca IN ('A', 'B') THEN o.lista END AS "Sucursales Origen CD",
         r.reemplazos AS "Reemplazos", coalesce(e.empresa, 'Solo Curifor') AS "Empresa",
         CASE WHEN t.sugerido > 0 THEN 'Si' ELSE 'No' END AS "Pedir",
         CASE WHEN t.importado THEN 'Importado' ELSE 'Nacional' END AS "Tipo Origen",
         t.punto AS "Punto de Pedido", t.sugerido AS "total_sugerido_suc",
         CASE WHEN t.sugerido > 0 THEN round(t.sugerido * k.costo, 2) END AS "total_valor_sugerido_clp",
         t.sugerido AS "sugerido_suc", CAST(t.activo AS BIGINT) AS "stock_activo_suc", CAST(t.en_transito AS BIGINT) AS "stock_en_transito_suc",
         CAST(t.stock_cd AS BIGINT) AS "stock_en_cd", t.traslado AS "sugerido_traslado", t.neta AS "sugerido_compra_neto",
         t.comprar_cd AS "comprar_en_el_cd", CASE WHEN t.sugerido > 0 THEN 'Si' ELSE 'No' END AS "pedir_flag", t.texto AS "trasladar_desde",
         {", ".join(f'CAST(sp."Stock NATION_{k}" AS BIGINT) AS "Stock NATION_{k}"' for k in range(11))}
  FROM tr t JOIN abcx a ON a.pm = t.pm AND a.suc = t.suc
  LEFT JOIN dims d ON d.sucursal = t.suc LEFT JOIN cat c ON c.producto = t.pm LEFT JOIN costo k ON k.producto = t.pm
  LEFT JOIN con_cd cd ON cd.producto = t.pm LEFT JOIN origen_cd o ON o.pm = t.pm LEFT JOIN reem r ON r.pm = t.pm
  LEFT JOIN empresa e ON e.pm = t.pm AND e.suc = t.suc LEFT JOIN pivote sp ON sp.pm = t.pm"""

PAIR = "pm AS producto_master, suc AS sucursal_final"

BODIES = {
    "signed_sales": """SELECT producto AS "Producto", sucursal AS "SUCURSAL", tipo_venta AS "TipoVenta", fecha AS "Fecha", cantidad AS "CantidadAjustada", fuente AS "Fuente" FROM ventas_m""",
    "border_sales": """SELECT producto AS "Producto", sucursal AS "SUCURSAL", tipo_venta AS "TipoVenta", fecha AS "Fecha", cantidad AS "CantidadAjustada", fuente AS "Fuente" FROM ventas_b""",
    "sales_union": """SELECT fuente AS "Fuente", sucursal AS "SUCURSAL", count(*) AS lineas, CAST(sum(cantidad) AS BIGINT) AS unidades FROM ventas GROUP BY ALL""",
    "sales_years": """SELECT producto AS "Producto", sucursal AS "SUCURSAL", fecha AS "Fecha", cantidad AS "CantidadAjustada" FROM ventas WHERE fecha >= DATE '2000-01-01'""",
    "tracking_union": """SELECT producto AS "Producto", sucursal AS "SucursalID", razon AS "RazonSocial", fecha_oc AS "FechaOC", noc AS "NOC", origen AS "Origen", motivo AS "Motivo" FROM seg""",
    "tracking_transit": """SELECT producto AS "Producto", sucursal AS "SucursalID", razon AS "RazonSocial", fecha_oc AS "FechaOC", noc AS "NOC", origen AS "Origen", motivo AS "Motivo",
        cantidad AS "Cantidad", estado_oc AS "EstadoOC", estado_doc AS "EstadoDoc", fecha_doc AS "FechaDoc" FROM seg""",
    "tracking_lead_time": """SELECT razon AS "RazonSocial", sucursal AS "SucursalID", fecha_oc AS "FechaOC", fecha_pe AS "FechaPE", origen AS "Origen", motivo AS "Motivo" FROM seg""",
    "prepare_sales": """SELECT producto AS "Producto", pm AS producto_master, suc AS sucursal_final, mes, cantidad AS "CantidadAjustada", fuente AS "Fuente" FROM prep""",
    "months_with_sale": f"SELECT {PAIR}, m3, m6, m12 FROM m_loc",
    "abc": f"SELECT {PAIR}, CAST(m3 AS BIGINT) AS m3, CAST(m6 AS BIGINT) AS m6, CAST(m12 AS BIGINT) AS m12, m3a, m6a, m12a, cl AS clasificacion_abc, ca AS clasificacion_abc_agregada FROM abcx",
    "cd_synthetic": "SELECT pm AS producto_master, m12a, ca AS clasificacion_abc_agregada FROM sint",
    "dense_series": f"SELECT {PAIR}, mes, total FROM serie12",
    "demand_local": f"SELECT {PAIR}, {rounded('media desv', 6).replace('AS media', 'AS demanda_mensual').replace('AS desv', 'AS desv_std_mensual')} FROM dem_loc",
    "demand_cd": "SELECT pm AS producto_master, round(media, 6) AS demanda_mensual, round(desv, 6) AS desv_std_mensual FROM dem_cd",
    "demand": f"SELECT {PAIR}, round(media, 6) AS demanda_mensual, round(desv, 6) AS desv_std_mensual, round(media / 22.0, 8) AS demanda_diaria FROM dem",
    "lead_time_supplier": """SELECT razon AS "Razon Social Proveedor", round(dias, 4) AS "Lead Time Dias" FROM lt_prov""",
    "lead_time_supplier_branch": """SELECT razon AS "Razon Social Proveedor", sucursal AS "SucursalID", round(dias, 4) AS "Lead Time Dias", n AS "N Muestras" FROM lt_suc""",
    "deduced_supplier": f"SELECT {PAIR}, prov_lt AS proveedor_lt FROM prov",
    "latest_supplier": """SELECT producto AS "Producto", sucursal AS "SucursalID", reciente FROM rec""",
    "lead_time": f"""SELECT {PAIR}, proveedor, prov_lt AS proveedor_lt, round(lt_dias, 4) AS lead_time_dias, lt_origen, lt_cd AS lt_cd_a_sucursal_dias,
        importado AS es_importado, abastece AS abastece_cd, round(lt_ef, 4) AS lt_efectivo FROM lt""",
    "safety_stock": f"SELECT {PAIR}, ss AS stock_seguridad FROM ss",
    "members": "SELECT pm AS producto_master, miembro FROM miembros",
    "active_stock": f"SELECT {PAIR}, CAST(stock AS BIGINT) AS stock_activo FROM activo",
    "in_transit": f"SELECT {PAIR}, CAST(stock AS BIGINT) AS stock_transito FROM transito",
    "suggestion": f"""SELECT {PAIR}, CAST(activo AS BIGINT) AS stock_activo, CAST(en_transito AS BIGINT) AS stock_transito, sugerido, necesidad AS necesidad_bruta, punto AS punto_pedido,
        CASE WHEN sugerido > 0 THEN 'Si' ELSE 'No' END AS pedir FROM sug""",
    "transfers": f"SELECT {PAIR}, CAST(prioridad AS INTEGER) AS prioridad_cd, CAST(stock_cd AS BIGINT) AS stock_cd, necesidad AS necesidad_bruta, traslado AS sugerido_traslado FROM tr",
    "buy_at_cd": f"SELECT {PAIR}, comprar_cd AS comprar_en_cd FROM tr WHERE comprar_cd IS NOT NULL",
    "net_purchase": f"SELECT {PAIR}, neta AS compra_neta FROM tr WHERE sugerido > 0",
    "lateral_text": f"SELECT {PAIR}, texto AS trasladar_desde FROM lateral_txt",
    "company_flag": f"SELECT a.pm AS producto_master, a.suc AS sucursal_final, coalesce(empresa, 'Solo Curifor') AS empresa FROM abcx a LEFT JOIN empresa e ON a.pm = e.pm AND a.suc = e.suc",
    "replacements": "SELECT pm AS producto_master, reemplazos FROM reem",
    "cd_sources": "SELECT c.pm AS producto_master, lista AS sucursales_origen_cd FROM cd_ab c JOIN origen_cd o ON c.pm = o.pm",
    "stock_pivot": f"""SELECT DISTINCT a.pm AS producto_master, {", ".join(f'CAST(sp."Stock NATION_{k}" AS BIGINT) AS "Stock NATION_{k}"' for k in range(11))} FROM abcx a LEFT JOIN pivote sp ON sp.pm = a.pm""",
    "stock_at_cd": "SELECT producto AS producto_master FROM con_cd",
    "catalogue_lookup": "SELECT producto AS producto_master, descripcion AS descripcion_cat, filtro1 AS filtro1_cat, unidad AS unidad_cat FROM cat",
    "cost_value": f"SELECT {PAIR}, round(costo, 4) AS costo_unitario, CASE WHEN sugerido > 0 THEN round(sugerido * costo, 2) END AS valor_clp FROM tr LEFT JOIN costo k ON k.producto = tr.pm",
    "contract": "SELECT * FROM plan",
}


def oracles() -> dict[str, str]:
    return {name: statement(CTES, body) for name, body in BODIES.items()}
