import sys

from curbflow.cli import main

sys.exit(main())
