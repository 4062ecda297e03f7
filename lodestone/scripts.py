"""Scripts of statements with what the engine answers to each; `queries` runs them and compares."""

from __future__ import annotations

#: Tables to import, and the statements in their order with their messages. Failed statements change nothing, so the script goes on.
SCRIPTS: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "constraint_refusals": (
        (),
        [
            ("CREATE TABLE P (id INT PRIMARY KEY)", "created table"),
            ("CREATE TABLE K (id INT PRIMARY KEY, p INT NULL REFERENCES P(id))", "created table"),
            ("INSERT INTO P VALUES (1), (2), (3)", "inserted 3 row(s)"),
            ("INSERT INTO K VALUES (10, 1), (30, NULL)", "inserted 2 row(s)"),
            ("CREATE TABLE Q (id INT, v DOUBLE NULL CHECK (v > 0.0))", "created table"),
            ("INSERT INTO Q VALUES (1, NULL)", "inserted 1 row(s)"),
            ("INSERT INTO Q VALUES (2, -1.0)", "CHECK constraint violation: v > 0.0"),
            ("INSERT INTO Q VALUES (NULL, 1.0)", "NOT NULL constraint violation on column id"),
            ("INSERT INTO K VALUES (40, 9)", "FOREIGN KEY constraint violation on column p"),
            ("INSERT INTO P VALUES (3)", "UNIQUE constraint violation on column id"),
            ("INSERT INTO P VALUES (4)", "inserted 1 row(s)"),
            ("INSERT INTO P VALUES (5), (5)", "UNIQUE constraint violation on column id"),
            ("UPDATE Q SET v = -3.0 WHERE id = 1", "CHECK constraint violation: v > 0.0"),
            ("UPDATE P SET id = 2 WHERE id = 4", "UNIQUE constraint violation on column id"),
            ("UPDATE K SET p = 8 WHERE id = 10", "FOREIGN KEY constraint violation on column p"),
            ("DELETE FROM P WHERE id = 1", "FOREIGN KEY constraint violation: key is still referenced"),
            ("UPDATE P SET id = 9 WHERE id = 1", "FOREIGN KEY constraint violation: key is still referenced"),
            ("DELETE FROM P WHERE id > 1", "deleted 3 row(s)"),
        ],
    ),
    "composite_keys": (
        (),
        [
            ("CREATE TABLE P (a INT, b INT, PRIMARY KEY (a, b))", "created table"),
            ("CREATE TABLE K (id INT PRIMARY KEY, a INT NULL, b INT NULL, UNIQUE (a, b), FOREIGN KEY (a, b) REFERENCES P(a, b) ON DELETE SET NULL)", "created table"),
            ("INSERT INTO P VALUES (1, 2), (1, 3)", "inserted 2 row(s)"),
            ("INSERT INTO P VALUES (1, 2)", "UNIQUE constraint violation on column a, b"),
            ("INSERT INTO K VALUES (10, 1, 2), (11, 1, NULL), (12, 1, NULL), (13, NULL, 2)", "inserted 4 row(s)"),
            ("INSERT INTO K VALUES (14, 1, 2)", "UNIQUE constraint violation on column a, b"),
            ("INSERT INTO K VALUES (14, 9, 9)", "FOREIGN KEY constraint violation on column a, b"),
            ("INSERT INTO K VALUES (14, 1, 3)", "inserted 1 row(s)"),
            ("UPDATE K SET b = 3 WHERE id = 10", "UNIQUE constraint violation on column a, b"),
            ("DELETE FROM P WHERE b = 2", "deleted 1 row(s)"),
        ],
    ),
    "foreign_key_rules": (
        (),
        [
            ("CREATE TABLE P (id INT PRIMARY KEY, name STRING UNIQUE, plain INT)", "created table"),
            ("CREATE TABLE A (p INT REFERENCES Nowhere(id))", "FOREIGN KEY parent table not found: Nowhere"),
            ("CREATE TABLE A (p INT REFERENCES P(other))", "FOREIGN KEY parent column not found: other"),
            ("CREATE TABLE A (p STRING REFERENCES P(id))", "FOREIGN KEY type mismatch: p"),
            ("CREATE TABLE A (p INT REFERENCES P(id) ON DELETE SET NULL)", "FOREIGN KEY SET NULL requires nullable child column: p"),
            ("CREATE TABLE A (p INT REFERENCES P(plain))", "FOREIGN KEY parent columns must be an exact PRIMARY KEY or UNIQUE key"),
            ("CREATE TABLE A (p STRING REFERENCES P(name) ON UPDATE CASCADE)", "created table"),
            ("DROP TABLE P", "cannot drop table P: referenced by a FOREIGN KEY"),
            ("RENAME TABLE P TO R", "cannot rename table P: referenced by a FOREIGN KEY"),
            ("ALTER TABLE P DROP COLUMN name", "cannot drop column name: referenced by a FOREIGN KEY"),
            ("DROP TABLE A", "dropped table"),
            ("DROP TABLE P", "dropped table"),
        ],
    ),
    "ddl_statements": (
        (),
        [
            ("CREATE TABLE T (id INT PRIMARY KEY, a INT NULL, CHECK (a > 0))", "created table"),
            ("CREATE TABLE T (x INT)", "table T already exists"),
            ("INSERT INTO T VALUES (1, 5), (2, NULL)", "inserted 2 row(s)"),
            ("CREATE INDEX i ON T(a)", "created index"),
            ("CREATE INDEX i ON T(id)", "index i already exists"),
            ("CREATE INDEX j ON T(nope)", "unknown indexed column nope"),
            ("CREATE INDEX __pk_x ON T(a)", "index name __pk_x is reserved"),
            ("DROP INDEX __pk_id ON T", "cannot drop constraint index __pk_id"),
            ("DROP INDEX nope ON T", "unknown index nope"),
            ("ALTER TABLE T DROP COLUMN a", "cannot drop column a: used by CHECK"),
            ("DROP INDEX i ON T", "dropped index"),
            ("ALTER TABLE T DROP COLUMN a", "cannot drop column a: used by CHECK"),
            ("ALTER TABLE T ADD COLUMN b INT NOT NULL", "NOT NULL column b needs a DEFAULT on a table with rows"),
            ("ALTER TABLE T ADD COLUMN b INT NOT NULL DEFAULT 4", "altered table"),
            ("ALTER TABLE T ADD COLUMN b INT NULL", "column b already exists"),
            ("ALTER TABLE T DROP COLUMN a CASCADE", "altered table"),
            ("ALTER TABLE T RENAME COLUMN b TO id", "column id already exists"),
            ("ALTER TABLE T RENAME COLUMN b TO c", "altered table"),
            ("ALTER TABLE T DROP COLUMN id CASCADE", "altered table"),
            ("ALTER TABLE T DROP COLUMN c", "cannot drop the last column"),
            ("INSERT INTO T VALUES (7)", "inserted 1 row(s)"),
            ("UPDATE T SET c = 8 WHERE c = 7", "updated 1 row(s)"),
            ("DELETE FROM T WHERE c = 8", "deleted 1 row(s)"),
            ("RENAME TABLE T TO U", "renamed table"),
            ("RENAME TABLE T TO V", "unknown table T"),
            ("ANALYZE TABLE U", "analyzed"),
            ("ANALYZE TABLE T", "unknown table T"),
            ("DROP TABLE T", "unknown table T"),
            ("DROP TABLE U", "dropped table"),
            ("DROP DATABASE other", "database is not active"),
            ("DROP DATABASE company", "dropped database"),
            ("LIST TABLES", "no active database"),
        ],
    ),
    "query_refusals": (
        ("C",),
        [
            ("SELECT c_nationkey, COUNT(*) FROM C", "selected column must appear in GROUP BY or an aggregate"),
            ("SELECT *, COUNT(*) FROM C", "SELECT * is not allowed with aggregates or GROUP BY"),
            ("SELECT COUNT(*) FROM C GROUP BY nope", "unknown GROUP BY column"),
            ("SELECT SUM(c_mktsegment) FROM C", "SUM/AVG require numeric arguments"),
            ("SELECT nope FROM C", "unknown column nope"),
            ("SELECT c_custkey FROM Nowhere", "unknown table Nowhere"),
            ("SELECT c_custkey FROM C UNION SELECT c_custkey, c_nationkey FROM C", "set operation requires equal column counts"),
            ("SELECT c_custkey FROM C UNION SELECT c_mktsegment FROM C", "set operation columns differ in type: c_custkey and c_mktsegment"),
            ('SELECT c_custkey FROM C WHERE c_mktsegment ~ "(["', "invalid regex pattern"),
            ("SELECT c_custkey FROM C JOIN C ON c_custkey = c_custkey", "ambiguous column reference c_custkey"),
            ("SELECT c_custkey FROM C WHERE c_custkey = ?", "statement parameters need EXECUTE"),
            ("INSERT INTO C VALUES (1)", "column count does not match the table"),
            ('INSERT INTO C VALUES ("x", 1, 1.0, "y")', "type mismatch on column c_custkey"),
            ("UPDATE C SET nope = 1", "unknown update column"),
            ("DELETE FROM C WHERE nope = 1", "unknown column nope"),
        ],
    ),
    "recursion_refusals": (
        ("C",),
        [
            ("WITH t AS (SELECT c_custkey FROM C WHERE c_custkey = 1 UNION ALL SELECT C.c_custkey FROM C JOIN t ON C.c_custkey = t.c_custkey) SELECT c_custkey FROM t", "line 1, column 129: CTE self-reference requires WITH RECURSIVE"),
            ("WITH RECURSIVE t AS ACCUMULATOR (SELECT c_custkey FROM C) SELECT c_custkey FROM t", "line 1, column 59: AS ACCUMULATOR requires a recursive UNION [ALL] CTE"),
            ("WITH RECURSIVE t AS (SELECT c_custkey FROM C UNION SELECT C.c_custkey FROM C JOIN t ON C.c_custkey = t.c_custkey ORDER BY c_custkey LIMIT 3) SELECT c_custkey FROM t", "line 1, column 142: ORDER BY / LIMIT on recursive CTE bodies is not supported"),
            ("WITH RECURSIVE t AS (SELECT c_custkey FROM C INTERSECT SELECT C.c_custkey FROM C JOIN t ON C.c_custkey = t.c_custkey) SELECT c_custkey FROM t", "line 1, column 119: WITH RECURSIVE requires a single UNION [ALL] between anchor and recursive arm"),
            ("WITH RECURSIVE t AS (SELECT c_custkey FROM t UNION SELECT c_custkey FROM C) SELECT c_custkey FROM t", "line 1, column 77: recursive CTE anchor must not reference a recursive CTE"),
            ("WITH RECURSIVE t AS (SELECT c_custkey FROM C UNION SELECT a.c_custkey FROM t a JOIN t b ON a.c_custkey = b.c_custkey) SELECT c_custkey FROM t", "line 1, column 119: recursive CTE arm must reference the recursive CTE name exactly once"),
            ("WITH RECURSIVE t AS (SELECT c_custkey FROM C UNION SELECT C.c_custkey, C.c_nationkey FROM C JOIN t ON C.c_custkey = t.c_custkey) SELECT c_custkey FROM t", "set operation requires equal column counts"),
        ],
    ),
    "statement_messages": (
        (),
        [
            ("CREATE TABLE T (id INT, v STRING NULL)", "created table"),
            ("BEGIN", "transaction started"),
            ("BEGIN", "transaction already active"),
            ('INSERT INTO T VALUES (1, "a"), (2, NULL)', "inserted 2 row(s)"),
            ("COMMIT", "transaction committed"),
            ("COMMIT", "no active transaction"),
            ("ROLLBACK", "no active transaction"),
            ("BEGIN", "transaction started"),
            ("DROP DATABASE company", "cannot drop a database in a transaction"),
            ("DELETE FROM T", "deleted 2 row(s)"),
            ("ROLLBACK", "transaction rolled back"),
            ("SELECT id FROM T", "selected rows"),
            ('UPDATE T SET v = "z" WHERE id = 2', "updated 1 row(s)"),
            ("DELETE FROM T WHERE id = 9", "deleted 0 row(s)"),
            ('PREPARE q AS "SELECT id FROM T WHERE v = ?"', "prepared statement"),
            ('EXECUTE q VALUES ("z")', "selected rows"),
            ("EXECUTE q VALUES ()", "not enough prepared statement parameters"),
            ("EXECUTE q VALUES (1, 2)", "too many prepared statement parameters"),
            ("EXECUTE r VALUES (1)", "unknown prepared statement"),
            ("LOAD DATABASE", "no saved database company"),
            ("SAVE DATABASE", "saved database"),
            ("LOAD DATABASE company", "loaded database"),
            ("LOAD DATABASE other", "no saved database other"),
            ("BEGIN", "transaction started"),
            ("SAVE DATABASE", "saved database"),
            ("ROLLBACK", "no active transaction"),
            ("BEGIN", "transaction started"),
            ("LOAD DATABASE", "loaded database"),
            ("COMMIT", "no active transaction"),
            ("LIST TABLES", "listed tables"),
            ("EXIT", "bye"),
        ],
    ),
}
