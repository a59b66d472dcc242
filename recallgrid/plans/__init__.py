"""Named queries over the test tables and the SQL they are checked against."""
from . import history, lifecycle, parsing, planning, retrieval, state, training, upkeep, views

CORE = (training, history, planning, state, retrieval, upkeep, parsing, views, lifecycle)
