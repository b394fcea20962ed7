"""tickloom: event-sourced market analytics written as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns); nothing here runs an action unless its name says ``write`` or
``run``.
"""

__version__ = "0.1.0"
