"""Classification of data sources and of the errors they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JDBC URL prefixes and the database type each stands for, first match wins.
URL_TYPES = (
    ("jdbc:derby:", "derby"),
    ("jdbc:log4jdbc:derby:", "derby"),
    ("jdbc:mysql:", "mysql"),
    ("jdbc:cobar:", "mysql"),
    ("jdbc:log4jdbc:mysql:", "mysql"),
    ("jdbc:mariadb:", "mariadb"),
    ("jdbc:oracle:", "oracle"),
    ("jdbc:log4jdbc:oracle:", "oracle"),
    ("jdbc:alibaba:oracle:", "AliOracle"),
    ("jdbc:microsoft:", "sqlserver"),
    ("jdbc:log4jdbc:microsoft:", "sqlserver"),
    ("jdbc:sqlserver:", "sqlserver"),
    ("jdbc:log4jdbc:sqlserver:", "sqlserver"),
    ("jdbc:sybase:Tds:", "sybase"),
    ("jdbc:log4jdbc:sybase:", "sybase"),
    ("jdbc:jtds:", "jtds"),
    ("jdbc:log4jdbc:jtds:", "jtds"),
    ("jdbc:fake:", "mock"),
    ("jdbc:mock:", "mock"),
    ("jdbc:postgresql:", "postgresql"),
    ("jdbc:log4jdbc:postgresql:", "postgresql"),
    ("jdbc:edb:", "edb"),
    ("jdbc:hsqldb:", "hsql"),
    ("jdbc:log4jdbc:hsqldb:", "hsql"),
    ("jdbc:odps:", "odps"),
    ("jdbc:db2:", "db2"),
    ("jdbc:sqlite:", "sqlite"),
    ("jdbc:ingres:", "ingres"),
    ("jdbc:h2:", "h2"),
    ("jdbc:log4jdbc:h2:", "h2"),
    ("jdbc:mckoi:", "mckoi"),
    ("jdbc:cloudscape:", "cloudscape"),
    ("jdbc:informix-sqli:", "informix"),
    ("jdbc:log4jdbc:informix-sqli:", "informix"),
    ("jdbc:timesten:", "timesten"),
    ("jdbc:as400:", "as400"),
    ("jdbc:sapdb:", "sapdb"),
    ("jdbc:JSQLConnect:", "JSQLConnect"),
    ("jdbc:JTurbo:", "JTurbo"),
    ("jdbc:firebirdsql:", "firebirdsql"),
    ("jdbc:interbase:", "interbase"),
    ("jdbc:pointbase:", "pointbase"),
    ("jdbc:edbc:", "edbc"),
    ("jdbc:mimer:multi1:", "mimer"),
    ("jdbc:dm:", "dm"),
    ("jdbc:kingbase:", "kingbase"),
    ("jdbc:gbase:", "gbase"),
    ("jdbc:xugu:", "xugu"),
    ("jdbc:log4jdbc:", "log4jdbc"),
    ("jdbc:hive:", "hive"),
    ("jdbc:hive2:", "hive"),
    ("jdbc:phoenix:", "phoenix"),
    ("jdbc:elastic:", "elastic_search"),
    ("jdbc:clickhouse:", "clickhouse"),
    ("jdbc:presto:", "presto"),
)

# Texts that must all occur in a message, and the error class they mean, by
# database and phase, first match wins; and the class of everything else.
CONNECT_ERRORS = {
    "mysql": (
        (("Unknown database",), "MYSQL_CONN_DB_ERROR"),
        (("Communications link failure",), "MYSQL_CONN_IPPORT_ERROR"),
        (("Access denied",), "MYSQL_CONN_USERPWD_ERROR"),
    ),
    "oracle": (
        (("ORA-12505",), "ORACLE_CONN_DB_ERROR"),
        (("The Network Adapter could not establish the connection",), "ORACLE_CONN_IPPORT_ERROR"),
        (("ORA-01017",), "ORACLE_CONN_USERPWD_ERROR"),
    ),
}
QUERY_ERRORS = {
    "mysql": (
        (("Table", "doesn't exist"), "MYSQL_QUERY_TABLE_NAME_ERROR"),
        (("SELECT command denied to user",), "MYSQL_QUERY_SELECT_PRI_ERROR"),
        (("Unknown column", "field list"), "MYSQL_QUERY_COLUMN_ERROR"),
        (("where clause",), "MYSQL_QUERY_SQL_ERROR"),
    ),
    "oracle": (
        (("table or view does not exist",), "ORACLE_QUERY_TABLE_NAME_ERROR"),
        (("invalid identifier",), "ORACLE_QUERY_SQL_ERROR"),
        (("insufficient privileges",), "ORACLE_QUERY_SELECT_PRI_ERROR"),
    ),
}
OTHER_CONNECT_ERROR = "CONN_DB_ERROR"
OTHER_QUERY_ERROR = "READ_RECORD_FAIL"
OTHER_DATABASE_ERROR = "SQL_EXECUTE_FAIL"


def database_type(url: Column) -> Column:
    """Database type of a JDBC URL, null where unknown."""
    branches = F.lit(None).cast("string")
    for prefix, name in reversed(URL_TYPES):
        branches = F.when(F.startswith(url, F.lit(prefix)), name).otherwise(branches)
    return branches


def sources_by_type(datasources: DataFrame, url: str = "jdbc_url") -> DataFrame:
    """Number of data sources of each type."""
    return datasources.groupBy(database_type(F.col(url)).alias("db_type")).agg(F.count(F.lit(1)).alias("sources"))


def _classify(db_type: Column, message: Column, rules: dict, fallback: str, other: str) -> Column:
    result = F.lit(other)
    for database, patterns in rules.items():
        found = F.lit(fallback)
        for texts, name in reversed(patterns):
            hit = F.lit(True)
            for text in texts:
                hit = hit & F.contains(message, F.lit(text))
            found = F.when(hit, name).otherwise(found)
        result = F.when(db_type == database, found).otherwise(result)
    return result


def connect_error(db_type: Column, message: Column) -> Column:
    """Class of an error raised while connecting."""
    return _classify(db_type, message, CONNECT_ERRORS, OTHER_CONNECT_ERROR, OTHER_CONNECT_ERROR)


def query_error(db_type: Column, message: Column) -> Column:
    """Class of an error raised by a query."""
    return _classify(db_type, message, QUERY_ERRORS, OTHER_QUERY_ERROR, OTHER_DATABASE_ERROR)


def error_class(db_type: Column, message: Column) -> Column:
    """Class of a run message whose phase is unknown: connection texts first, then query texts."""
    connecting = connect_error(db_type, message)
    return F.when(connecting != OTHER_CONNECT_ERROR, connecting).otherwise(query_error(db_type, message))


def error_classes(messages: DataFrame, db_type: str = "db_type", message: str = "message") -> DataFrame:
    """Number of run messages of each class."""
    return messages.groupBy(error_class(F.col(db_type), F.col(message)).alias("error_class")).agg(F.count(F.lit(1)).alias("messages"))


def jdbc_host(url: Column) -> Column:
    """Host part of a JDBC URL in lower case: without ``?…``, after ``@``, else after ``//``."""
    base = F.substring_index(url, "?", 1)
    after_at = F.regexp_extract(base, "@(.*)$", 1)
    after_slashes = F.regexp_extract(base, "//(.*)$", 1)
    return F.lower(F.when(F.contains(base, F.lit("@")), after_at).when(F.contains(base, F.lit("//")), after_slashes).otherwise(base))


# How a logged statement names its table and its database.
SQL_TABLE = r"(?i)from\s+(\w+)(\s+where|\s*$)"
LOGGED_URL = r"(?i)jdbcUrl:\s*\[(.+?)\]"


def sql_table(line: Column) -> Column:
    """Table after FROM in a logged statement, in lower case; empty where none is found."""
    return F.lower(F.regexp_extract(line, SQL_TABLE, 1))


def logged_url(line: Column) -> Column:
    """JDBC URL in a log line, empty where there is none."""
    return F.regexp_extract(line, LOGGED_URL, 1)
