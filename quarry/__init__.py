"""quarry: workspace indexing and retrieval as Spark jobs.

Entry points:

* ``quarry.sources.workspace_fs.read_workspace`` - inventory a file tree (Python data source);
* ``quarry.plans.index_jobs.index_scan / index_embed / index_all`` - build a catalogue;
* ``quarry.plans.tools`` - list, find, search text, read slices, vector search over a catalogue;
* ``quarry.operators`` - the DataFrame operators the jobs are made of;
* ``quarry.streaming.catalog_stream.start_catalog_stream`` - keep a catalogue table current from a stream.
"""

__version__ = "0.1.0"
