"""The catalog's results in SQL, over the same tables."""

from __future__ import annotations

from feedloom.plans.views import (
    BATCH, BLOCKS, BUFFER, BYTE_LIMIT, DAY_US, EXTRA_LOADER, GAP_US, LOADERS, PARQUET_ROWS, SEED, STAGES, TAR_ROWS, WORKERS,
)
from feedloom.schemas import BATCH_SIZES, MEMORY_BANDS, ROW_CAP, SMOKE_BATCHES, UTIL_BANDS

_KEY = f"md5('{SEED}:0:' || doc_id)"



def _mean(metric: str) -> str:
    return f"round(avg({metric}), 6)"


_VIEWS = {
    "placed": f"placed AS (SELECT *, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents)",
    "blocks": f"blocks AS (SELECT *, doc_id * {BLOCKS} // count(*) OVER () AS block FROM documents)",
    "shards": f"shards AS (SELECT DISTINCT doc_id // {TAR_ROWS} AS shard_id FROM documents)",
    "ranked": f"ranked AS (SELECT shard_id, row_number() OVER (ORDER BY md5('{SEED}:0:' || shard_id), shard_id) - 1 AS rank FROM shards)",
    "bytes": f"""bytes AS (SELECT doc_id, size, dense_rank() OVER (ORDER BY grid) - 1 AS shard_id FROM (
        SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) // {BYTE_LIMIT} AS grid
        FROM (SELECT doc_id, strlen(text) AS size FROM documents)))""",
    "byte_shards": """byte_shards AS (SELECT shard_id, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes,
        min(doc_id) AS first_id, max(doc_id) AS last_id FROM bytes GROUP BY shard_id)""",
    "batch_log": f"""batch_log AS (SELECT event_id, event_type AS run, epoch_us(ts) // {DAY_US} AS epoch, epoch_us(ts) AS got_us,
        epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000 AS done_us, epoch_us(ts) // {DAY_US} * {DAY_US} AS start_us,
        user_id % 128 + 1 AS n FROM events)""",
    "timeline": """timeline AS (SELECT *, row_number() OVER w - 1 AS i, CAST(sum(n) OVER w AS BIGINT) AS samples,
        got_us - coalesce(lag(done_us) OVER w, start_us) AS wait_us
        FROM batch_log WINDOW w AS (PARTITION BY run, epoch ORDER BY got_us, event_id))""",
    "gauges": f"""gauges AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, value, event_type AS dataset,
        CASE WHEN user_id % 4 = 3 THEN '{EXTRA_LOADER}' WHEN user_id % 3 = 0 THEN '{LOADERS[0]}'
             WHEN user_id % 3 = 1 THEN '{LOADERS[1]}' ELSE '{LOADERS[2]}' END AS loader,
        CAST(CASE user_id % 4 WHEN 0 THEN {BATCH_SIZES[0]} WHEN 1 THEN {BATCH_SIZES[1]} ELSE {BATCH_SIZES[2]} END AS BIGINT) AS batch_size
        FROM events)""",
    "results": f"""results AS (SELECT *, CASE WHEN busy_ms > 0 THEN round(total_samples * 1000.0::DOUBLE / busy_ms, 2) ELSE 0 END AS samples_per_sec FROM (
        SELECT loader, dataset, batch_size, us // {DAY_US} AS epoch, count(*) AS batches,
        CAST(sum(user_id % 128 + 1) AS BIGINT) AS total_samples, CAST(sum(floor(value)) AS BIGINT) AS busy_ms, max(value) AS peak_value
        FROM gauges GROUP BY ALL))""",
    "averages": f"""averages AS (SELECT loader, dataset, batch_size, count(*) AS epochs, {_mean("samples_per_sec")} AS samples_per_sec,
        {_mean("peak_value")} AS peak_value FROM results GROUP BY ALL)""",
    "points": f"""points AS (SELECT loader, dataset, batch_size, samples_per_sec FROM averages WHERE loader <> '{EXTRA_LOADER}'
        UNION ALL SELECT c.loader, c.dataset, c.batch_size, a.samples_per_sec FROM
        (SELECT DISTINCT loader, dataset, unnest({BATCH_SIZES})::BIGINT AS batch_size FROM averages WHERE loader = '{EXTRA_LOADER}') c
        LEFT JOIN averages a USING (loader, dataset, batch_size))""",
    "pixels": """pixels AS (SELECT vec_id, i - 1 AS i, CAST(greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5))) AS BIGINT) AS p
        FROM embeddings, unnest(range(1, 65)) AS u(i))""",
}


_MARKED = """, f AS (SELECT *, dataset = 'error' AS ended, coalesce(lag(dataset = 'error') OVER w OR us - lag(us) OVER w >= 3600000000, true)::BIGINT AS starts
            FROM gauges WINDOW w AS (PARTITION BY loader ORDER BY us, event_id)),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY loader ORDER BY us, event_id) AS run FROM f),
        m AS (SELECT loader, min(us) AS start_us, max(us) AS last_us, count(*) FILTER (NOT ended) AS readings, bool_or(ended) AS by_marker
            FROM g GROUP BY loader, run HAVING count(*) FILTER (NOT ended) > 0)"""
_ORDERS = f"""o AS (
            SELECT 'global' AS method, doc_id AS id, pos FROM placed
        UNION ALL SELECT 'block', doc_id, row_number() OVER (ORDER BY md5('{SEED}:0:' || block), block, doc_id) - 1 FROM blocks
        UNION ALL SELECT 'shard', doc_id, row_number() OVER (ORDER BY md5('{SEED}:0:' || (doc_id // {TAR_ROWS})), doc_id // {TAR_ROWS}, doc_id) - 1 FROM documents
        UNION ALL SELECT 'buffer', doc_id, row_number() OVER (ORDER BY doc_id // {TAR_ROWS}, doc_id % {TAR_ROWS} // {BUFFER}, {_KEY}, doc_id) - 1 FROM documents)"""


def _with(*names: str, body: str) -> str:
    return f"WITH {', '.join(_VIEWS[n] for n in names)} {body}"


_RESULTS = ("gauges", "results")
_AVERAGES = (*_RESULTS, "averages")
_TIMELINE = ("batch_log", "timeline")
_BYTES = ("bytes", "byte_shards")

_TOKENS = "list_transform(string_split(text, ''), lambda c: unicode(c) % 50257)"


def _band(steps: list[int]) -> str:
    return "CAST(CASE " + " ".join(f"WHEN value >= {s} THEN {i}" for i, s in reversed(list(enumerate(steps)))) + " ELSE -1 END AS BIGINT)"


def _weights(source: int, target: int) -> str:
    """Per output place its two bilinear taps (s0, w0, s1, w1), in units of 2**-22."""
    return f"""taps AS (SELECT o, s, greatest(0, 1 - abs(s - ((o + 0.5::DOUBLE) * {source} / {target}) + 0.5)) AS near
        FROM unnest(range(0, {target})) AS a(o), unnest(range(0, {source})) AS b(s)),
    scaled AS (SELECT o, s, CAST(floor(near / sum(near) OVER (PARTITION BY o) * 4194304 + 0.5) AS BIGINT) AS w FROM taps QUALIFY near > 0),
    weights AS (SELECT o, min(s) AS s0, arg_min(w, s) AS w0, max(s) AS s1, CASE WHEN count(*) > 1 THEN arg_max(w, s) ELSE 0 END AS w1 FROM scaled GROUP BY o)"""


ORACLES: dict[str, str] = {
    # ---- sources and sinks
    "scan_jsonl": "SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS text_md5 FROM documents",
    "block_layout": _with("blocks", body="SELECT block, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM blocks GROUP BY block"),
    "tar_roundtrip": f"""SELECT printf('%08d', doc_id) AS sample_key, printf('shard-%06d.tar', doc_id // {TAR_ROWS}) AS shard,
        strlen(text) AS n_bytes, md5(text) AS text_md5 FROM documents""",
    "indexed_roundtrip": """SELECT doc_id, CAST(to_json({'lang': lang, 'source': source}) AS VARCHAR) AS meta, md5(text) AS text_md5 FROM documents""",
    "indexed_greedy": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS oversized, count(*) AS covered_ids FROM documents",
    "random_access": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "pushed_slices": """WITH n AS (SELECT count(*) AS n FROM documents), cuts AS (
            SELECT n // 10 AS slice_start, n // 10 + 100 AS slice_end FROM n UNION ALL SELECT n // 2, n // 2 + 40 FROM n UNION ALL SELECT n - 30, n FROM n)
        SELECT unnest(['indexed', 'tar']) AS format, doc_id, md5(text) AS text_md5, slice_start FROM documents JOIN cuts ON doc_id >= slice_start AND doc_id < slice_end""",
    "tar_index": f"""WITH t AS (SELECT doc_id, doc_id // {TAR_ROWS} AS shard_id, strlen(text) AS n, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL)
        SELECT printf('shard-%06d.tar', shard_id) AS shard, row_number() OVER s - 1 AS place, printf('%08d', doc_id) AS sample_key, 'txt' AS field,
            CAST(sum(512 + (n + 511) // 512 * 512) OVER s - (n + 511) // 512 * 512 AS BIGINT) AS "offset", n AS n_bytes, text_md5
        FROM t WINDOW s AS (PARTITION BY shard_id ORDER BY doc_id)""",
    "bucketed_epochs": f"""SELECT epoch, pos * {WORKERS} // n AS worker, pos, doc_id, md5(text) AS text_md5 FROM (
        SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY epoch) AS n
        FROM documents, (SELECT unnest(range(0, 3)) AS epoch))""",
    "feed_blocks": f"""WITH t AS (SELECT *, count(*) OVER () AS n, greatest(1, count(*) OVER () // {PARQUET_ROWS}) AS n_shards FROM documents),
        s AS (SELECT doc_id, text, least(doc_id // (n // n_shards), n_shards - 1) AS block, unnest([0, 1])::BIGINT AS epoch FROM t),
        b AS (SELECT epoch, block, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || block), block) - 1 AS block_rank
            FROM (SELECT DISTINCT epoch, block FROM s))
        SELECT epoch, doc_id, block_rank, row_number() OVER (PARTITION BY epoch ORDER BY block_rank, doc_id) - 1 AS place, md5(text) AS text_md5 FROM s JOIN b USING (epoch, block)""",
    "greedy_shards": f"""WITH RECURSIVE sized AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, coalesce(strlen(text), 0)::BIGINT AS size FROM documents),
        walk AS (
            SELECT i, doc_id, size, 0::BIGINT AS shard_id, size AS used FROM sized WHERE i = 1
            UNION ALL SELECT s.i, s.doc_id, s.size, shard_id + (used + s.size > {BYTE_LIMIT})::BIGINT, CASE WHEN used + s.size > {BYTE_LIMIT} THEN s.size ELSE used + s.size END
            FROM walk JOIN sized s ON s.i = walk.i + 1)
        SELECT shard_id, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM walk GROUP BY shard_id""",
    "mapped_samples": """SELECT printf('%08d', doc_id) AS sample_key, len(lines)::BIGINT AS n_lines, list_max(list_transform(lines, lambda x: length(x))) AS longest_line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)""",
    "layout_pairs": """SELECT printf('%08d', doc_id) AS sample_key, concat_ws(':', quality, toxic) AS cls, md5(text) AS text_md5
        FROM documents JOIN labels USING (doc_id)""",
    "shard_list": f"""SELECT printf('shard-%06d.tar', doc_id // {TAR_ROWS}) AS file, count(*) AS n_rows FROM documents GROUP BY ALL""",
    "results_roundtrip": _with(*_RESULTS, body=f"""SELECT printf('%s_%s_bs%d_w%d_epoch%d', loader, dataset, batch_size, {WORKERS}, epoch) AS run, loader, dataset, batch_size, CAST({WORKERS} AS BIGINT) AS num_workers, epoch,
        total_samples, samples_per_sec FROM results"""),
    "fanout_formats": "SELECT unnest(['parquet', 'tar', 'indexed']) AS format, doc_id, md5(text) AS text_md5 FROM documents",
    "parquet_shards": f"""WITH t AS (SELECT doc_id, count(*) OVER () AS n, greatest(1, count(*) OVER () // {PARQUET_ROWS}) AS n_shards FROM documents),
        s AS (SELECT doc_id, n_shards, least(doc_id // (n // n_shards), n_shards - 1) AS shard_id FROM t)
        SELECT shard_id, printf('shard-%05d-of-%05d.parquet', shard_id, n_shards) AS file, count(*) AS n_rows,
        min(doc_id) AS first_id, max(doc_id) AS last_id FROM s GROUP BY ALL""",
    "tar_shards": f"""SELECT doc_id // {TAR_ROWS} AS shard_id, printf('shard-%06d.tar', doc_id // {TAR_ROWS}) AS file, count(*) AS n_rows,
        CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL""",
    "shard_manifest": f"""SELECT printf('shard-%06d.tar', doc_id // {TAR_ROWS}) AS file, count(*) AS n_rows,
        CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL""",
    "byte_shards": _with(*_BYTES, body="SELECT * FROM byte_shards"),
    "resolve_samples": _with("bytes", body=f"""SELECT doc_id, shard_id, doc_id - min(doc_id) OVER (PARTITION BY shard_id) AS place,
        doc_id // {TAR_ROWS} AS fixed_shard, doc_id % {TAR_ROWS} AS fixed_place FROM bytes"""),
    "storage_footprint": f"""WITH shards AS (SELECT doc_id // {TAR_ROWS} AS shard_id,
            sum(512 + (strlen(text) + 511) // 512 * 512) + 1024 AS raw, sum(strlen(text)) AS held FROM documents GROUP BY ALL)
        SELECT 'tar files' AS what, count(*) AS files, CAST(sum((raw + 10239) // 10240 * 10240) AS BIGINT) AS bytes,
            round(sum((raw + 10239) // 10240 * 10240)::DOUBLE / 1e9, 6) AS gb FROM shards
        UNION ALL SELECT 'payload', count(*), CAST(sum(held) AS BIGINT), round(sum(held)::DOUBLE / 1e9, 6) FROM shards""",
    "shard_balance": _with(*_BYTES, body="""SELECT count(*) AS n_shards, min(n_rows) AS min_rows, max(n_rows) AS max_rows, round(avg(n_rows), 3) AS avg_rows,
        min(bytes) AS min_bytes, max(bytes) AS max_bytes, round(avg(bytes), 3) AS avg_bytes FROM byte_shards"""),
    # ---- scalar functions
    "dense_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS file_pos, row_number() OVER (ORDER BY doc_id) - 1 AS sample_id FROM documents",
    "id_range": """SELECT doc_id // 250 * 250 AS slice_start, doc_id // 250 * 250 + 250 AS slice_end, count(*) AS n_rows, min(doc_id) AS first_id,
        max(doc_id) AS last_id, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ALL""",
    "sample_keys": "SELECT doc_id, printf('%08d', doc_id) AS sample_key FROM documents",
    "utf8_sizes": "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_chars, decode(encode(text)) = text AS same FROM documents",
    "meta_json": """SELECT event_id, CAST(to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR) AS meta FROM events""",
    "first_field": """WITH t AS (SELECT 'benchmark' AS corpus, 'text' AS field, text AS body FROM benchmark UNION ALL SELECT 'conversations', 'text', text FROM conversations
            UNION ALL SELECT 'documents', 'text', text FROM documents UNION ALL SELECT 'pages', 'html', html FROM pages)
        SELECT corpus, field, count(*) AS n_rows, CAST(sum(length(coalesce(nullif(body, ''), corpus))) AS BIGINT) AS n_chars FROM t GROUP BY ALL""",
    "char_tokens": f"SELECT doc_id, CASE WHEN length(text) = 0 THEN '' ELSE array_to_string({_TOKENS}, ',') END AS tokens FROM documents",
    "padded_tokens": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token, unnest(range(0, length(text))) AS i FROM documents WHERE length(text) > 0)
        SELECT d.doc_id, coalesce(i // 128, 0) AS chunk, CAST(128 AS BIGINT) AS width, CAST(coalesce(sum(token * (i % 128 + 1)), 0) AS BIGINT) AS checksum
        FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY ALL""",
    "normalise_vectors": "SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE / 255)) AS x FROM embeddings",
    "stack_vectors": f"""WITH t AS (SELECT vec_id // {BATCH} AS batch_id, (vec_id % {BATCH}) * 64 + i AS place, embedding[i]::DOUBLE AS x
            FROM embeddings, unnest(range(1, 65)) AS u(i))
        SELECT batch_id, (count(*) // 64) || 'x64' AS shape, CAST(sum(CAST(floor(x * 1000000) AS BIGINT) * place) AS BIGINT) AS checksum FROM t GROUP BY batch_id""",
    "decoded_images": _with("pixels", body="""SELECT vec_id, '8x8x3' AS shape, md5(unhex(string_agg(repeat(printf('%02x', p), 3), '' ORDER BY i))) AS pixels_md5
        FROM pixels GROUP BY vec_id"""),
    "resized_images": _with("pixels", body=f""", {_weights(8, 224)},
        lines AS (SELECT vec_id, i // 8 AS y, list(p ORDER BY i) AS line FROM pixels GROUP BY ALL),
        wide AS (SELECT vec_id, y, list((line[s0 + 1] * w0 + line[s1 + 1] * w1 + 2097152) // 4194304 ORDER BY o) AS line FROM lines, weights GROUP BY ALL),
        tall AS (SELECT a.vec_id, o, array_to_string(list_transform(range(1, 225),
                lambda x: printf('%02x', (a.line[x] * w0 + b.line[x] * w1 + 2097152) // 4194304)), '') AS row_hex
            FROM weights JOIN wide a ON a.y = s0 JOIN wide b ON b.y = s1 AND b.vec_id = a.vec_id),
        planes AS (SELECT vec_id, string_agg(row_hex, '' ORDER BY o) AS plane FROM tall GROUP BY vec_id)
        SELECT vec_id, '3x224x224' AS shape, md5(unhex(repeat(plane, 3))) AS pixels_md5 FROM planes"""),
    "series_labels": _with("gauges", body="""SELECT printf('%s / %s / bs=%d', loader, dataset, batch_size) AS series, printf('%s/bs=%d', loader, batch_size) AS short_series,
        count(*) AS readings FROM gauges GROUP BY loader, dataset, batch_size"""),
    "run_names": _with(*_RESULTS, body=f"""SELECT printf('%s_%s_bs%d_w%d_epoch%d', loader, dataset, batch_size, {WORKERS}, epoch) AS run, total_samples FROM results"""),
    "stamped_results": _with(*_RESULTS, body=f"""SELECT loader, dataset, batch_size, epoch, samples_per_sec, CAST({WORKERS} AS BIGINT) AS num_workers,
        'cpu' AS gpu_name, 'local' AS hostname FROM results"""),
    # ---- filters and validation
    "row_cap": f"""SELECT sample_id, sample_id // {ROW_CAP} AS portion, o_orderkey, o_totalprice
        FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id, o_orderkey, o_totalprice FROM orders)""",
    "batch_cap": _with("placed", body=f"""SELECT pos // {BATCH} // {SMOKE_BATCHES} AS smoke_run, pos // {BATCH} AS batch_id, count(*) AS n_rows,
        CAST(sum(n_chars) AS BIGINT) AS n_chars FROM placed GROUP BY ALL"""),
    "nonempty_samples": _with("batch_log", body=f"""SELECT g.run, g.epoch, g.hour, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS samples
        FROM (SELECT DISTINCT run, epoch, unnest(range(0, 24)) AS hour FROM batch_log) g
        LEFT JOIN batch_log b ON b.run = g.run AND b.epoch = g.epoch AND b.got_us % {DAY_US} // 3600000000 = g.hour GROUP BY ALL"""),
    "starved_workers": _with("shards", body="""SELECT num_workers, worker, n_shards FROM (SELECT num_workers, unnest(range(0, num_workers)) AS worker
        FROM (SELECT unnest([4, 8, 16, 128])::BIGINT AS num_workers)), (SELECT count(*) AS n_shards FROM shards) WHERE worker >= n_shards"""),
    "shape_check": f"""SELECT doc_id // {BATCH} AS batch_id, count(*) AS n_rows, count(DISTINCT n_chars // 500) AS n_shapes, min(n_chars // 500) AS min_shape,
        max(n_chars // 500) AS max_shape, CAST(count(DISTINCT n_chars // 500) = 1 AS BIGINT) AS stackable FROM documents GROUP BY ALL""",
    "time_range": """SELECT event_id, epoch_us(ts) AS ts_us, value FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-08 04:59:48.017' AND TIMESTAMP '2024-01-22 06:15:29.096'""",
    "nonnull_series": _with(*_AVERAGES, "points", body="""SELECT p.* FROM points p SEMI JOIN
        (SELECT loader, batch_size FROM points GROUP BY ALL HAVING count(samples_per_sec) > 0) s USING (loader, batch_size)"""),
    # ---- orders
    "global_shuffle": _with("placed", body="SELECT doc_id, pos FROM placed"),
    "shuffled_rows": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "buffer_shuffle": f"""SELECT doc_id, w * {BUFFER} + row_number() OVER (PARTITION BY s, w ORDER BY {_KEY}, doc_id) - 1 AS out_pos
        FROM (SELECT doc_id, doc_id // {TAR_ROWS} AS s, doc_id % {TAR_ROWS} // {BUFFER} AS w FROM documents)""",
    "buffer_stream": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id // {TAR_ROWS}
        ORDER BY doc_id % {TAR_ROWS} + ('0x' || substr({_KEY}, 1, 8))::BIGINT % {BUFFER}, {_KEY}, doc_id) - 1 AS out_pos FROM documents""",
    "shard_shuffle": _with("shards", "ranked", body="SELECT shard_id, rank FROM ranked"),
    "worker_round_robin": _with("shards", "ranked", body=f"SELECT shard_id, rank, rank % {WORKERS} AS worker FROM ranked"),
    "index_shuffle": _with("placed", body=f"SELECT doc_id, pos, pos * {WORKERS} // total AS worker FROM placed"),
    "index_shuffle_fetch": _with("placed", body=f"SELECT pos * {WORKERS} // total AS worker, pos, doc_id, md5(text) AS text_md5 FROM placed"),
    "block_shuffle": _with("blocks", body=f""", b AS (SELECT block, row_number() OVER (ORDER BY md5('{SEED}:0:' || block), block) - 1 AS block_rank
            FROM (SELECT DISTINCT block FROM blocks))
        SELECT doc_id, block, block_rank, row_number() OVER (ORDER BY block_rank, doc_id) - 1 AS pos FROM blocks JOIN b USING (block)"""),
    "materialised_epochs": _with("placed", body=f""", e AS (SELECT unnest([1, 2])::BIGINT AS epoch),
        b AS (SELECT epoch, doc_id, pos AS place, pos * {BLOCKS} // total AS block FROM placed, e)
        SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || block), block, place) - 1 AS pos FROM b"""),
    "epoch_orders": f"""SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id) - 1 AS pos
        FROM documents, (SELECT unnest(range(0, 3)) AS epoch)""",
    "shuffle_quality": _with("placed", "blocks", body=f""", {_ORDERS},
        p AS (SELECT *, lag(pos) OVER (PARTITION BY method ORDER BY id) AS prev FROM o)
        SELECT method, count(*) AS n, round(avg(abs(pos - id)), 4) AS avg_move, max(abs(pos - id)) AS max_move,
        count(*) FILTER (pos = prev + 1) AS kept_neighbours, count(*) FILTER (pos = id) AS fixed_points, round(corr(id, pos), 4) AS order_corr FROM p GROUP BY method"""),
    "order_inversions": _with("placed", "blocks", body=f""", {_ORDERS},
            t AS (SELECT a.method, count(*) AS turned FROM o a JOIN o b ON a.method = b.method AND a.id < b.id AND a.pos > b.pos GROUP BY a.method)
        SELECT o.method, count(*) AS n, coalesce(any_value(turned), 0) AS inversions,
        round(coalesce(any_value(turned), 0)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1) / 2), 6) AS turned_share FROM o LEFT JOIN t USING (method) GROUP BY o.method"""),
    "batch_mix": _with("placed", body=f""", c AS (SELECT pos // {BATCH} AS batch_id, lang, count(*) AS n FROM placed GROUP BY ALL),
            w AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY lang),
            b AS (SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels FROM c GROUP BY batch_id)
        SELECT batch_id, n_rows, n_labels, round(sum(abs(coalesce(n, 0)::DOUBLE / n_rows - p)) / 2, 6) AS mix_distance
        FROM b CROSS JOIN w LEFT JOIN c USING (batch_id, lang) GROUP BY ALL"""),
    # ---- batches
    "shape_batches": _with("placed", body=f""", s AS (SELECT doc_id, n_chars // 500 AS shape, pos FROM placed),
            t AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY pos) - 1 AS seat, count(*) OVER (PARTITION BY shape) AS total FROM s),
            f AS (SELECT *, max(pos) OVER (PARTITION BY shape, seat // {BATCH // 4}) AS ready FROM t WHERE seat < total // {BATCH // 4} * {BATCH // 4}),
            r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS place FROM t WHERE seat >= total // {BATCH // 4} * {BATCH // 4})
        SELECT doc_id, shape, pos, dense_rank() OVER (ORDER BY ready) - 1 AS batch_id, false AS resize FROM f
        UNION ALL SELECT doc_id, shape, pos, (SELECT count(DISTINCT ready) FROM f) + place // {BATCH // 4}, true FROM r"""),
    "batches_partial": _with("shards", "ranked", body=f""", s AS (SELECT doc_id, n_chars, rank % {WORKERS} AS worker,
            row_number() OVER (PARTITION BY rank % {WORKERS} ORDER BY rank, doc_id) - 1 AS seat FROM documents JOIN ranked ON shard_id = doc_id // {TAR_ROWS})
        SELECT worker, seat // {BATCH} AS batch_id, count(*) AS n_rows, min(doc_id) AS min_id, max(doc_id) AS max_id, CAST(sum(n_chars) AS BIGINT) AS n_chars
        FROM s GROUP BY ALL"""),
    "batches_drop_last": _with("placed", body=f"""SELECT pos // {BATCH} AS batch_id, count(*) = {BATCH} AS "full", count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS id_sum,
        CAST(sum(n_chars) AS BIGINT) AS n_chars FROM placed GROUP BY pos // {BATCH}"""),
    "batches_global": _with("placed", body=f"""SELECT pos // {BATCH} AS batch_id, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS id_sum,
        CAST(sum(n_chars) AS BIGINT) AS n_chars FROM placed GROUP BY ALL"""),
    "block_batches": _with("blocks", body=f"""SELECT block, count(*) AS n_rows, (count(*) + {BATCH - 1}) // {BATCH} AS n_batches,
        count(*) - ((count(*) + {BATCH - 1}) // {BATCH} - 1) * {BATCH} AS last_rows FROM blocks GROUP BY block"""),
    "collate_text": _with("placed", body=f"""SELECT pos // {BATCH} AS batch_id, count(*) AS n_rows, string_agg(doc_id::VARCHAR, ',' ORDER BY pos) AS doc_ids,
        md5(string_agg(text, '|' ORDER BY pos)) AS texts_md5 FROM placed GROUP BY ALL"""),
    "batch_tokens": _with("placed", body=f"""SELECT pos // {BATCH} AS batch_id, count(*) AS n_rows, CAST(sum(greatest(1, (length(text) + 127) // 128)) AS BIGINT) AS n_sequences,
        CAST(sum(length(text)) AS BIGINT) AS n_tokens, round(1 - sum(length(text))::DOUBLE / (128 * sum(greatest(1, (length(text) + 127) // 128))), 4) AS pad_share FROM placed GROUP BY ALL"""),
    "inflight_bytes": _with("blocks", body=""", s AS (SELECT block, count(*) AS n_rows, count(*) * 150528 AS decoded_bytes FROM blocks GROUP BY block)
        SELECT *, (SELECT CAST(sum(decoded_bytes) AS BIGINT) FROM (SELECT decoded_bytes FROM s ORDER BY decoded_bytes DESC LIMIT 3)) AS peak_bytes FROM s"""),
    "feed_tar": f"""WITH d AS (SELECT printf('%08d', doc_id) AS sample_key, printf('shard-%06d.tar', doc_id // {TAR_ROWS}) AS shard, doc_id % {TAR_ROWS} // {BUFFER} AS w,
            length(text) AS n_tokens FROM documents),
        o AS (SELECT *, w * {BUFFER} + row_number() OVER (PARTITION BY shard, w ORDER BY md5('{SEED}:0:' || sample_key), sample_key) - 1 AS out_pos FROM d),
        s AS (SELECT shard, n, row_number() OVER (ORDER BY md5('{SEED}:0:' || shard), shard) - 1 AS rank FROM (SELECT shard, count(*) AS n FROM d GROUP BY shard)),
        b AS (SELECT shard, rank % 2 AS worker, CAST(sum(n) OVER (PARTITION BY rank % 2 ORDER BY rank) - n AS BIGINT) AS before FROM s)
        SELECT sample_key, worker, before + out_pos AS seat, (before + out_pos) // {BATCH} AS batch_id, n_tokens FROM o JOIN b USING (shard)""",
    "feed_indexed": _with("placed", body=f""", w AS (SELECT doc_id, pos * 2 // total AS worker, pos, length(text) AS n_tokens FROM placed),
        s AS (SELECT *, pos - min(pos) OVER (PARTITION BY worker) AS seat, count(*) OVER (PARTITION BY worker) AS n FROM w)
        SELECT doc_id, worker, seat, seat // {BATCH} AS batch_id, seat < n // {BATCH} * {BATCH} AS "full", n_tokens FROM s"""),
    "feed_parquet": _with("placed", body=f"""SELECT doc_id, CAST(0 AS BIGINT) AS worker, pos AS seat, pos // {BATCH} AS batch_id, length(text) AS n_tokens FROM placed"""),
    "prepare_corpus": """SELECT unnest(['parquet', 'indexed']) AS format, doc_id, CAST(to_json({'lang': lang, 'source': source}) AS VARCHAR) AS meta,
        md5(text) AS text_md5 FROM documents""",
    # ---- joins and grids
    "pair_samples": "SELECT printf('%08d', doc_id) AS sample_key, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "unpaired_samples": """SELECT doc_id, 'label' AS missing FROM documents ANTI JOIN labels USING (doc_id)
        UNION ALL SELECT doc_id, 'document' FROM labels ANTI JOIN documents USING (doc_id)""",
    "tar_entries": """WITH p AS (SELECT printf('%08d', doc_id) AS sample_key, text, quality FROM documents JOIN labels USING (doc_id))
        SELECT sample_key, sample_key || '.txt' AS entry, strlen(text) AS bytes FROM p UNION ALL
        SELECT sample_key, sample_key || '.cls', strlen(quality::VARCHAR) FROM p WHERE quality IS NOT NULL""",
    "experiment_matrix": _with(*_RESULTS, body=f"""SELECT g.dataset, g.loader, g.batch_size, CAST(coalesce(sum(r.batches), 0) AS BIGINT) AS batches
        FROM (SELECT dataset, loader, unnest({BATCH_SIZES})::BIGINT AS batch_size FROM (SELECT dataset, unnest({LOADERS}) AS loader FROM (SELECT DISTINCT event_type AS dataset FROM events))) g
        LEFT JOIN results r USING (dataset, loader, batch_size) GROUP BY ALL"""),
    "append_series": _with(*_AVERAGES, "points", body="SELECT * FROM points"),
    # ---- feed analytics
    "epoch_metrics": _with("batch_log", body="""SELECT run, epoch, count(*) AS batches, CAST(sum(n) AS BIGINT) AS total_samples,
        round((max(done_us) - min(start_us)) / 1e6::DOUBLE, 3) AS elapsed_sec,
        CASE WHEN max(done_us) > min(start_us) THEN round(sum(n)::DOUBLE / ((max(done_us) - min(start_us)) / 1e6::DOUBLE), 2) ELSE 0 END AS samples_per_sec
        FROM batch_log GROUP BY ALL"""),
    "data_stall": _with(*_TIMELINE, body="""SELECT run, epoch, wait_us, elapsed_us, elapsed_us - wait_us AS compute_us,
        CASE WHEN elapsed_us > 0 THEN round(100.0::DOUBLE * wait_us / elapsed_us, 2) ELSE 0 END AS data_stall_pct
        FROM (SELECT run, epoch, CAST(sum(wait_us) AS BIGINT) AS wait_us, max(done_us) - min(start_us) AS elapsed_us FROM timeline GROUP BY ALL)"""),
    "stage_shares": "SELECT user_id, " + ", ".join(
        f"CASE WHEN sum(us) > 0 THEN round(100.0::DOUBLE * coalesce(sum(us) FILTER (event_type = '{s}'), 0) / sum(us), 2) ELSE 0 END AS {s}_pct" for s in STAGES
    ) + " FROM (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) * 1000 AS us FROM events) GROUP BY user_id",
    "gauge_summary": _with("gauges", body="""SELECT loader, batch_size,
        coalesce(round(avg(value) FILTER (dataset = 'view'), 2), 0) AS gpu_util_pct, coalesce(round(min(value) FILTER (dataset = 'view'), 2), 0) AS gpu_util_min,
        coalesce(round(max(value) FILTER (dataset = 'click'), 3), 0) AS gpu_mem_gb, coalesce(round(avg(value) FILTER (dataset = 'error'), 2), 0) AS cpu_util_pct,
        coalesce(round(max(value) FILTER (dataset = 'purchase'), 3), 0) AS ram_used_gb, coalesce(round(avg(value) FILTER (dataset = 'signup'), 3), 0) AS shm_used_gb,
        coalesce(round(max(value) FILTER (dataset = 'signup'), 3), 0) AS shm_peak_gb FROM gauges GROUP BY ALL"""),
    "epoch_average": _with(*_AVERAGES, body="SELECT * FROM averages"),
    "comparison_pivot": _with(*_RESULTS, body=""", a AS (SELECT loader || '_' || batch_size AS col, """ + _mean("samples_per_sec") + """ AS samples_per_sec,
            """ + _mean("peak_value") + """ AS peak_value FROM results GROUP BY ALL),
        l AS (SELECT col, 'samples_per_sec' AS metric, samples_per_sec AS value FROM a UNION ALL SELECT col, 'peak_value', peak_value FROM a)
        SELECT metric, """ + ", ".join(f"max(value) FILTER (col = '{c}') AS {c}" for c in [f"{l}_{b}" for l in LOADERS for b in BATCH_SIZES] + [f"{EXTRA_LOADER}_128"])
        + " FROM l GROUP BY metric"),
    "panel_stats": _with("gauges", body="""SELECT loader, dataset, batch_size, min(value) AS min_value, max(value) AS max_value, round(avg(value), 4) AS mean_value
        FROM gauges GROUP BY ALL"""),
    "threshold_bands": _with("gauges", body=f"""SELECT loader, {_band(UTIL_BANDS)} AS band, count(*) AS readings, 'util' AS panel FROM gauges GROUP BY ALL
        UNION ALL SELECT loader, {_band(MEMORY_BANDS)}, count(*), 'memory' FROM gauges GROUP BY ALL"""),
    "corpus_profile": """SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
        round(avg(length(text)), 4) AS avg_chars, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, arg_min(length(text), doc_id) AS first_chars FROM documents""",
    "baseline_ratio": _with(*_AVERAGES, body="""SELECT loader, dataset, batch_size, samples_per_sec,
        samples_per_sec / nullif(max(samples_per_sec) FILTER (loader = 'parquet') OVER (PARTITION BY dataset, batch_size), 0) AS ratio FROM averages"""),
    "batch_waits": _with(*_TIMELINE, body="SELECT run, epoch, i, wait_us FROM timeline"),
    "running_rate": _with(*_TIMELINE, body="""SELECT run, epoch, i, samples,
        CASE WHEN done_us > start_us THEN round(samples / ((done_us - start_us) / 1e6::DOUBLE), 4) ELSE 0 END AS running_sps FROM timeline"""),
    "active_batches": _with(*_TIMELINE, body="""SELECT run, epoch, CASE WHEN i < 2 THEN 'wait' WHEN i < 3 THEN 'warmup' WHEN i < 8 THEN 'active' ELSE 'done' END AS phase,
        count(*) AS batches, CAST(sum(wait_us) AS BIGINT) AS wait_us, CAST(sum(n) AS BIGINT) AS samples FROM timeline GROUP BY ALL"""),
    "first_batch_latency": _with(*_TIMELINE, body="""SELECT run, epoch, max(wait_us) FILTER (i = 0) AS first_wait_us, round(avg(wait_us) FILTER (i > 0), 2) AS later_wait_us
        FROM timeline GROUP BY ALL"""),
    # ---- telemetry
    "gauge_windows": _with("gauges", body="""SELECT loader, dataset, batch_size, us // 1000000 AS second, avg(value) AS mean_value, max(value) AS max_value,
        count(value) AS readings FROM gauges GROUP BY ALL"""),
    "gauge_latest": _with("gauges", body="""SELECT loader, dataset, batch_size, us // 5000000 AS refresh, arg_max(value, (ts, event_id)) AS last_value FROM gauges GROUP BY ALL"""),
    "gauge_visible": _with("gauges", body=""", seen AS (
            SELECT *, unnest(range((us + 59999999) // 60000000, (us + 300000000) // 60000000 + 1)) * 60000000 AS refresh_us FROM gauges)
        SELECT loader, dataset, batch_size, refresh_us, arg_max(value, (us, event_id)) AS visible_value, refresh_us - max(us) AS age_us FROM seen GROUP BY loader, dataset, batch_size, refresh_us"""),
    "run_spans": _with("batch_log", body=f""", f AS (SELECT run, event_id, got_us, coalesce(got_us - lag(got_us) OVER w >= {GAP_US}, false)::BIGINT AS starts
            FROM batch_log WINDOW w AS (PARTITION BY run ORDER BY got_us, event_id)),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY run ORDER BY got_us, event_id) AS span FROM f)
        SELECT run, min(got_us) AS start_us, max(got_us) AS last_us, count(*) AS readings FROM g GROUP BY run, span"""),
    "gauge_windows_stream": _with("gauges", body="""SELECT loader, dataset, batch_size, us // 1000000 * 1000000 AS window_us, avg(value) AS mean_value, max(value) AS max_value,
        count(value) AS readings FROM gauges GROUP BY ALL"""),
    "gauge_latest_stream": _with("gauges", body="""SELECT loader, dataset, batch_size, us // 5000000 * 5000000 AS window_us, arg_max(value, (ts, event_id)) AS last_value
        FROM gauges GROUP BY ALL"""),
    "run_spans_stream": _with("batch_log", body=f""", f AS (SELECT run, event_id, got_us, coalesce(got_us - lag(got_us) OVER w >= {GAP_US}, false)::BIGINT AS starts
            FROM batch_log WINDOW w AS (PARTITION BY run ORDER BY got_us, event_id)),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY run ORDER BY got_us, event_id) AS span FROM f)
        SELECT run, min(got_us) AS start_us, max(got_us) AS last_us, count(*) AS readings FROM g GROUP BY run, span"""),
    "marked_runs": _with("gauges", body=f"{_MARKED} SELECT * FROM m"),
    "marked_runs_stream": _with("gauges", body=f"{_MARKED} SELECT loader, 'run' AS kind, start_us, last_us, readings, by_marker FROM m"),
    "gauge_upserts": _with("gauges", body="""SELECT loader, dataset, batch_size, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
        FROM gauges GROUP BY ALL"""),
    "live_counters": _with("batch_log", body="""SELECT run, epoch, count(*) AS batches, CAST(sum(n) AS BIGINT) AS total_samples, min(start_us) AS start_us,
        max(done_us) AS done_us FROM batch_log GROUP BY ALL"""),
}
