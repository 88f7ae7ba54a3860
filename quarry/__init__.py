"""quarry — tabular analysis operators on PySpark.

Every operator takes DataFrames (plus role/column arguments) and returns a lazy
DataFrame; nothing is collected to the driver.  See README.md for the layout.
"""

from quarry.functions.quantiles import release_pinned
from quarry.session import configure_session, get_session, scratch_path

__all__ = ["get_session", "configure_session", "scratch_path", "release_pinned"]
