"""SQL fragments that Spark SQL and DuckDB spell differently, so a query is stated once.

Spark runs the query; DuckDB runs the same text as the oracle of the tests.
"""

from __future__ import annotations

from dataclasses import dataclass

DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def posexplode(self, array: str, i: str, v: str) -> str:
        """Select-list items: the elements as v, their positions from 0 as i."""
        return f"posexplode({array}) AS ({i}, {v})" if self.spark else f"unnest({array}) AS {v}, generate_subscripts({array}, 1) - 1 AS {i}"

    def explode(self, array: str, v: str) -> str:
        return f"explode({array}) AS {v}" if self.spark else f"unnest({array}) AS {v}"

    def series(self, low: str, high: str, i: str) -> str:
        """Select-list item: the whole numbers from low to high, none if high is less."""
        if self.spark:
            return f"explode(if(({high}) < ({low}), cast(array() AS array<bigint>), sequence(cast({low} AS bigint), cast({high} AS bigint)))) AS {i}"
        return f"unnest(range(cast({low} AS bigint), cast({high} AS bigint) + 1)) AS {i}"

    def split(self, text: str, delimiter: str) -> str:
        """Array of the parts between one-character delimiters, empty parts too."""
        if self.spark:
            return f"split({text}, '[{delimiter}]', -1)".replace("\n", "\\n").replace("\t", "\\t")
        return f"string_split({text}, chr({ord(delimiter)}))"

    def char(self, c: str) -> str:
        return f"chr({ord(c)})"

    def count_of(self, text: str, c: str) -> str:
        return f"(length({text}) - length(replace({text}, chr({ord(c)}), '')))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def hex_of(self, text: str) -> str:
        """Upper-case hexadecimal of the UTF-8 bytes."""
        return f"hex(encode({text}, 'UTF-8'))" if self.spark else f"hex(encode({text}))"

    def n_bytes(self, text: str) -> str:
        return f"octet_length({text})" if self.spark else f"octet_length(encode({text}))"

    def unhex_text(self, x: str) -> str:
        return f"cast(unhex({x}) AS string)" if self.spark else f"decode(unhex({x}))"

    def list_of(self, x: str, order: str) -> str:
        """Aggregate: x as an array ordered by order."""
        if self.spark:
            return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), p -> p.v)"
        return f"list({x} ORDER BY {order})"

    def struct_min(self, value: str, *order: str) -> str:
        """Aggregate: value at the least order."""
        return f"min_by({value}, struct({', '.join(order)}))" if self.spark else f"arg_min({value}, ({', '.join(order)}))"

    def date_days(self, text: str) -> str:
        """Days since 1970-01-01 of a canonical date, as bigint."""
        return f"cast(datediff(try_cast({text} AS date), DATE '1970-01-01') AS bigint)" if self.spark else f"cast(datediff('day', DATE '1970-01-01', try_cast({text} AS date)) AS bigint)"

    def matches(self, text: str, pattern: str) -> str:
        return f"{text} RLIKE r'{pattern}'" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def canonical_int(self, text: str) -> str:
        return f"coalesce(cast(try_cast({text} AS bigint) AS {self.text}) = {text}, false)"

    def canonical_date(self, text: str) -> str:
        ok = self.matches(text, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        return f"coalesce({ok} AND try_cast({text} AS date) IS NOT NULL AND year(try_cast({text} AS date)) BETWEEN 1800 AND 2400, false)"

    @property
    def text(self) -> str:
        return "string" if self.spark else "varchar"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def at(self, array: str, i: str) -> str:
        """Element i, counted from 1."""
        return f"element_at({array}, cast({i} AS int))" if self.spark else f"{array}[cast({i} AS int)]"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def lshift(self, x: str, n: int) -> str:
        return f"({x} * {1 << n})"

    def rshift(self, x: str, n: int) -> str:
        return f"({x} div {1 << n})" if self.spark else f"({x} // {1 << n})"

    def div(self, x: str, y: str) -> str:
        """Whole-number division of values that are not negative."""
        return f"(({x}) div ({y}))" if self.spark else f"(({x}) // ({y}))"

    def uvarint(self, x: str) -> str:
        """Bytes of a base-128 number that is not negative: one for each seven bits begun."""
        return "(CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END)"

    def zigzag(self, x: str) -> str:
        return f"(CASE WHEN {x} >= 0 THEN 2 * {x} ELSE -2 * {x} - 1 END)"


SPARK, DUCK = Dialect(True), Dialect(False)
