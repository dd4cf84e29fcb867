from sparkloom.sources.catalog import Catalog, TableDef
from sparkloom.sources.csv_loader import import_csv
from sparkloom.sources.ddl import parse_create_table
from sparkloom.sources.tables import TABLES, register, table

__all__ = ["TABLES", "Catalog", "TableDef", "import_csv", "parse_create_table", "register", "table"]
