"""SQL fragments of the checking queries, written from the definitions rather than from the operators."""

from tilewright.functions.cells import ALPHABET

PI = "pi()"


def geohash(lng: str, lat: str, level: int | str = 11) -> str:
    qx = f"least(CAST(floor(({lng} + 180) / CAST(360 AS DOUBLE) * 268435456) AS BIGINT), 268435455)"
    qy = f"least(CAST(floor(({lat} + 90) / CAST(180 AS DOUBLE) * 134217728) AS BIGINT), 134217727)"

    def bit(b: int) -> str:
        return f"(({qx} >> {27 - b // 2}) & 1)" if b % 2 == 0 else f"(({qy} >> {26 - b // 2}) & 1)"

    if isinstance(level, int):
        chars = []
        for k in range(level):
            value = " + ".join(f"{bit(5 * k + j)} * {1 << (4 - j)}" for j in range(5))
            chars.append(f"substr('{ALPHABET}', CAST(1 + {value} AS INTEGER), 1)")
        return "concat(" + ", ".join(chars) + ")"
    return f"substr({geohash(lng, lat, 11)}, 1, {level})"


def r(e: str, n: int) -> str:
    return f"(round({e}, {n}) + CAST(0 AS DOUBLE))"


def seq(low: str, high: str) -> str:
    return f"unnest(generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT)))"
