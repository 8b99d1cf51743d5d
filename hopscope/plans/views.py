"""Packet-like views over the driver's tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each view: (Spark SQL, DuckDB SQL); {t} is the table.
_US = "unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"
VIEWS = {
    "pkt": (
        "events",
        rf"""SELECT event_id AS frame, {_US} AS ts_us, user_id AS flow, IF(event_type IN ('click', 'view', 'signup'), 'C2S', 'S2C') AS dir,
            event_type AS endpoint, value / 1000 AS latency_s, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS payload_len,
            concat('10.79.', CAST(user_id DIV 256 AS STRING), '.', CAST(user_id % 256 AS STRING)) AS cip FROM {{t}}""",
        r"""SELECT event_id AS frame, epoch_us(ts) AS ts_us, user_id AS flow, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'C2S' ELSE 'S2C' END AS dir,
            event_type AS endpoint, value / 1000 AS latency_s, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS payload_len,
            concat('10.79.', user_id // 256, '.', user_id % 256) AS cip FROM events""",
    ),
    "packet": (
        "events",
        rf"""SELECT frame, ts_us, IF(frame % 50 = 0, 34525, 2048) AS ethertype, element_at(array(6, 6, 17, 6, 1), CAST(frame % 5 AS INT) + 1) AS ip_proto,
            concat('10.79.', CAST(flow DIV 256 AS STRING), '.', CAST(flow % 256 AS STRING)) AS src,
            concat(element_at(array('172.18.', '203.0.', '8.8.', '100.64.'), CAST(frame % 4 AS INT) + 1), CAST(frame % 7 AS STRING), '.', CAST(frame % 300 AS STRING)) AS dst,
            CAST(IF(frame % 97 = 0, 0, 1024 + flow) AS INT) AS sport, element_at(array(443, 80, 8080, 53, 22, 27018, 4444), CAST(frame % 7 AS INT) + 1) AS dport,
            unhex(element_at(array('170303025801020304', '474554202F6120485454502F312E31', '485454502F312E3120323030204F4B', '', '1603010010',
                '170303025801020304', '5055542F61', '485454502F312E3120343034204E6F', '', '160303001002000000', '1703030010020203', '434F4E4E454354206120485454502F31', '48545450', '', '160303001001000000'), CAST(frame % 15 AS INT) + 1)) AS payload,
            element_at(array('GET', 'POST', 'get', 'PUT', 'CONNECT'), CAST(frame % 5 AS INT) + 1) AS method,
            element_at(array('02:00:00:00:00:01', '01:00:5e:00:00:fb', 'ff:ff:ff:ff:ff:ff'), CAST(frame % 3 AS INT) + 1) AS eth_dst,
            element_at(array('0x1301', '0xc02f', '0xc030', '0xbeef'), CAST(frame % 4 AS INT) + 1) AS cipher
            FROM (SELECT event_id AS frame, {_US} AS ts_us, user_id AS flow FROM {{t}})""",
        r"""SELECT frame, ts_us, CASE WHEN frame % 50 = 0 THEN 34525 ELSE 2048 END AS ethertype, ([6, 6, 17, 6, 1])[frame % 5 + 1] AS ip_proto,
            concat('10.79.', flow // 256, '.', flow % 256) AS src,
            concat((['172.18.', '203.0.', '8.8.', '100.64.'])[frame % 4 + 1], frame % 7, '.', frame % 300) AS dst,
            CASE WHEN frame % 97 = 0 THEN 0 ELSE 1024 + flow END AS sport, ([443, 80, 8080, 53, 22, 27018, 4444])[frame % 7 + 1] AS dport,
            unhex((['170303025801020304', '474554202F6120485454502F312E31', '485454502F312E3120323030204F4B', '', '1603010010',
                '170303025801020304', '5055542F61', '485454502F312E3120343034204E6F', '', '160303001002000000', '1703030010020203', '434F4E4E454354206120485454502F31', '48545450', '', '160303001001000000'])[frame % 15 + 1]) AS payload,
            (['GET', 'POST', 'get', 'PUT', 'CONNECT'])[frame % 5 + 1] AS method,
            (['02:00:00:00:00:01', '01:00:5e:00:00:fb', 'ff:ff:ff:ff:ff:ff'])[frame % 3 + 1] AS eth_dst,
            (['0x1301', '0xc02f', '0xc030', '0xbeef'])[frame % 4 + 1] AS cipher
            FROM (SELECT event_id AS frame, epoch_us(ts) AS ts_us, user_id AS flow FROM events)""",
    ),
    "url": ("pages", "SELECT page_id, url FROM {t}", "SELECT page_id, url FROM pages"),
    "line": ("documents", "SELECT doc_id, pos, line FROM {t} LATERAL VIEW posexplode(split(text, '\\n')) AS pos, line", "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"),
    "mac_acct": ("lineitem", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM {t}", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem"),
}

_CRLF = "chr(13), chr(10)"
# HTTP traffic between clients and servers: empty and foreign payloads, methods of all kinds, absolute URIs, and
# acknowledgements that fall short of the last request's end. The same SQL in both dialects but for three parts.
_EXCHANGE = f"""SELECT concat('c', flow % 2) AS capture, frame, ts_us, flow, 2048 AS ethertype, 6 AS ip_proto, req,
    CASE WHEN req THEN client ELSE server END AS src, CASE WHEN req THEN cport ELSE port END AS sport,
    CASE WHEN req THEN server ELSE client END AS dst, CASE WHEN req THEN port ELSE cport END AS dport,
    CAST(CASE WHEN req THEN sent - n ELSE back - n END AS BIGINT) AS seq,
    CAST(CASE WHEN req THEN back WHEN frame % 4 = 0 THEN sent - 5 ELSE sent END AS BIGINT) AS ack, CAST(n AS INT) AS payload_len, payload
  FROM (SELECT *, sum(CASE WHEN req THEN n ELSE 0 END) OVER (PARTITION BY flow ORDER BY frame) AS sent, sum(CASE WHEN req THEN 0 ELSE n END) OVER (PARTITION BY flow ORDER BY frame) AS back
  FROM (SELECT *, octet_length(payload) AS n FROM (SELECT *, CASE WHEN frame % 19 = 0 THEN unhex('1703030258010203') WHEN frame % 17 = 0 THEN unhex('') ELSE {{encode}} END AS payload
  FROM (SELECT *, CASE WHEN req THEN concat(split_part('GET,POST,GET,CONNECT,TRACE,get', ',', CAST(frame % 6 AS INT) + 1), ' ',
      CASE WHEN frame % 11 = 0 THEN concat('/eticketing/protected/AvlFarEnquiry/', frame % 5) WHEN frame % 13 = 0 THEN concat('http://h', flow % 3, '.example/a/b/c', frame % 4, '?q=', frame) ELSE concat('/shop/', frame % 7, '/item/', 100000 + frame % 3) END,
      ' HTTP/1.1', {_CRLF}, 'Host: h', flow % 3, {_CRLF}, 'X-Id: ', frame % 4, {_CRLF}, {_CRLF})
    ELSE concat('HTTP/1.1 ', CASE WHEN frame % 10 < 7 THEN '200 OK' WHEN frame % 10 < 9 THEN '404 Not Found' ELSE '503 Service Unavailable' END, {_CRLF}, 'Server: s', {_CRLF}, 'Content-Length: 3', {_CRLF}, {_CRLF}, 'abc') END AS m
  FROM (SELECT *, concat('10.79.', CAST(floor(flow / 256) AS BIGINT), '.', flow % 256) AS client, CAST(20000 + flow AS INT) AS cport,
      concat('172.18.', flow % 4, '.', flow % 7) AS server, CAST(split_part('80,8080,8000,8888,443', ',', CAST(flow % 5 AS INT) + 1) AS INT) AS port
  FROM (SELECT event_id AS frame, {{us}} AS ts_us, user_id AS flow, event_type IN ('click', 'view', 'signup') AS req FROM {{t}}))))))"""
VIEWS["exchange"] = ("events", _EXCHANGE.replace("{encode}", "encode(m, 'ISO-8859-1')").replace("{us}", _US), _EXCHANGE.replace("{encode}", "encode(m)").replace("{us}", "epoch_us(ts)").replace("{t}", "events"))

# Look-up tables and lines of the kinds that the operators take, made of the driver's tables by the same SQL in both
# dialects (but for the parts in braces).
_SITE = "CASE s_suppkey % 4 WHEN 0 THEN '10.79.' WHEN 1 THEN '172.18.' WHEN 2 THEN '8.8.' ELSE '203.0.' END"
_PREFIX = f"""SELECT net, plen, min(asn) AS asn, min(name) AS name FROM (
    SELECT concat({_SITE}, s_suppkey % 5, '.0') AS net, 24 AS plen, concat('', 64600 + s_nationkey) AS asn, s_name AS name FROM {{t}}
    UNION ALL SELECT concat({_SITE}, '0.0') AS net, 16, concat('', 64500 + s_suppkey % 4), concat('Site ', s_suppkey % 4) FROM {{t}}
    UNION ALL SELECT '10.0.0.0', 8, '64499', 'Backbone' FROM {{t}}) GROUP BY net, plen"""
_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '')"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_DERIVED = {
    # a component for each range of an event type's values
    "model": ("events", """SELECT model_id, comp, round(n / sum(n) OVER (PARTITION BY model_id), 9) AS weight, mean, var FROM (
        SELECT model_id, comp, CAST(count(*) AS DOUBLE) AS n, round(avg(v), 9) AS mean, round(var_pop(v) + 0.00001, 12) AS var FROM (
        SELECT model_id, v, CASE WHEN v < 0.02 * f THEN 0 WHEN v < 0.06 * f THEN 1 WHEN v < 0.2 * f THEN 2 ELSE 3 END AS comp FROM (
        SELECT CASE event_type WHEN 'view' THEN 'total' WHEN 'click' THEN 'rest' ELSE 'edge' END AS model_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.6 ELSE 0.3 END AS f,
        value / 1000 * CAST(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS v FROM {t} WHERE event_type IN ('view', 'click', 'purchase'))) GROUP BY model_id, comp)"""),
    "node": ("nation", "SELECT lower(n_name) AS node, CASE n_nationkey % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'rest' WHEN 2 THEN 'edge' ELSE 'total' END AS total_capture, CASE n_nationkey % 4 WHEN 0 THEN 'rest' WHEN 1 THEN 'edge' WHEN 3 THEN 'absent' END AS rest_capture FROM {t}"),
    "prefix": ("supplier", _PREFIX),
    "cell": ("supplier", f"SELECT asn, min(name) AS name, concat({{lines}}, chr(10), ' ', chr(10), 'broken') AS prefixes FROM ({_PREFIX}) GROUP BY asn"),
    "subnet": ("supplier", "SELECT DISTINCT concat(CASE s_nationkey % 3 WHEN 0 THEN '10.79.0.' WHEN 1 THEN '172.18.3.' ELSE '8.8.4.' END, (s_nationkey * 8) % 256, '/29') AS cidr FROM {t} UNION SELECT '8.8.0.0/13' FROM {t}"),
    "vendor": ("supplier", "SELECT mac, min(vendor) AS vendor FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN '02:00:00:00:00:01' WHEN 1 THEN '01:00:5e:00:00:fb' ELSE concat('02:00:00:00:01:', s_suppkey % 90 + 10) END AS mac, concat(s_name, ', Inc.') AS vendor FROM {t}) GROUP BY mac"),
    "pattern": ("pages", f"SELECT min(page_id) AS pattern_id, pattern FROM (SELECT page_id, {_HOST} AS pattern FROM {{t}} UNION ALL SELECT page_id, substring({_PATH}, 1, 4 + page_id % 5) FROM {{t}}) WHERE pattern <> '' GROUP BY pattern"),
    "filter": ("pages", f"SELECT min(page_id) AS pattern_id, tokens FROM (SELECT page_id, concat(split_part({_HOST}, '.', 1), ' ', CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'utm_source' END) AS tokens FROM {{t}} WHERE page_id % 4 <> 3) GROUP BY tokens"),
    "hosts": ("pages", f"SELECT DISTINCT {_HOST} AS host FROM {{t}} WHERE page_id % 3 = 0"),
    "raw_uri": ("pages", f"SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('/eticket/protected/AvlFarEnquiry/', page_id) WHEN 1 THEN {_PATH} WHEN 2 THEN url WHEN 3 THEN concat('/x//y', page_id % 7, '/FareEnq?z') ELSE '' END AS uri FROM {{t}}"),
    "start_line": ("pages", f"SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('GET ', {_PATH}, '?q=1 HTTP/1.1') WHEN 1 THEN 'HTTP/1.1 404 Not Found' WHEN 2 THEN concat('  post   /deadbeef12/', page_id * 100003, '/b HTTP/1.0 extra ') WHEN 3 THEN 'Weird' ELSE concat('PUT ', url) END AS line FROM {{t}}"),
    "raw_url": ("pages", f"SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN concat(url, '/api/AB12/82902/MMCT/f3109944/?q=1') WHEN 3 THEN concat('http://Shop.Example.com:8080/x', page_id, '/Y1/zz9') ELSE 'https://a.b' END AS u FROM {{t}}"),
}
_LINES = ("array_join(array_sort(collect_list(concat(net, '/', plen))), concat(chr(10), ' '))", "string_agg(concat(net, '/', plen), concat(chr(10), ' ') ORDER BY concat(net, '/', plen))")
for _name, (_table, _sql) in _DERIVED.items():
    VIEWS[_name] = (_table, _sql.replace("{lines}", _LINES[0]), _sql.replace("{lines}", _LINES[1]).replace("{t}", _table))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the driver's tables."""
    table, sql, _ = VIEWS[name]
    return spark.sql(sql.format(t="{t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(sql: str, *views: str) -> str:
    """A DuckDB query with the views that it names in front."""
    parts = [f"{n} AS ({VIEWS[n][2]})" for n in VIEWS if n in views]
    head = ("WITH " + ",\n".join(parts)) if parts else ""
    if head and sql.startswith("WITH "):
        return head + ",\n" + sql[5:]
    return (head + "\n" if head else "") + sql
