"""Options of the activity report (the reference's 24 parameters)."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default column list, the default sort and the kinds of filter.
DEFAULT_COLUMN_LIST = ("[dd%][session_id][sql_text][sql_command][login_name][wait_info][tasks]"
                       "[tran_log%][cpu%][temp%][block%][reads%][writes%][context%][physical%]"
                       "[query_plan][locks][%]")
DEFAULT_SORT = "[start_time] ASC"
FILTER_TYPES = ("session", "program", "database", "login", "host")


@dataclass(frozen=True)
class ReportOptions:
    filter: str = ""
    filter_type: str = "session"
    not_filter: str = ""
    not_filter_type: str = "session"
    show_own_spid: bool = False
    own_session_id: int | None = None
    show_system_spids: bool = False
    show_sleeping_spids: int = 1
    get_full_inner_text: bool = False
    get_plans: int = 0
    get_outer_command: bool = False
    get_transaction_info: bool = False
    get_task_info: int = 1
    get_locks: bool = False
    get_avg_time: bool = False
    get_additional_info: bool = False
    find_block_leaders: bool = False
    delta_interval: int = 0
    output_column_list: str = DEFAULT_COLUMN_LIST
    sort_order: str = DEFAULT_SORT
    format_output: int = 1
    destination_table: str = ""
    return_schema: bool = False
    # With a delta, keep only each instance's latest snapshot (the
    # earlier ones only serve as the delta's base).
    latest_snapshot_only: bool = False
    keys: tuple[str, ...] = field(default=("instance_id", "collection_time"))

    def __post_init__(self):
        if self.filter_type not in FILTER_TYPES or self.not_filter_type not in FILTER_TYPES:
            raise ValueError(f"filter types must be one of {FILTER_TYPES}")
        if self.show_sleeping_spids not in (0, 1, 2):
            raise ValueError("show_sleeping_spids must be 0, 1 or 2")
        if self.get_task_info not in (0, 1, 2):
            raise ValueError("get_task_info must be 0, 1 or 2")
        if self.format_output not in (0, 1, 2):
            raise ValueError("format_output must be 0, 1 or 2")
        if self.get_plans not in (0, 1, 2):
            raise ValueError("get_plans must be 0, 1 or 2")
        if not 0 <= self.delta_interval <= 255:
            raise ValueError("delta_interval must be between 0 and 255")
