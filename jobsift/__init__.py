"""jobsift: job-screening analytics as Spark DataFrame jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver.  See README.md for the map from
operator ids to functions.
"""

__version__ = "0.1.0"
