from playseq.sources.events import rounds_from_events
from playseq.sources.tables import complete_rounds, read_rounds, write_table

__all__ = ["complete_rounds", "read_rounds", "rounds_from_events", "write_table"]
