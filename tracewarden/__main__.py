import sys

from tracewarden.engine import main

sys.exit(main())
